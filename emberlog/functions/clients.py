"""Client key of a request."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.functions.messages import trim_space


def client_key(forwarded: Column, address: Column) -> Column:
    """First entry of a forwarded list, else the address without its port.

    A list that starts with a comma has no first entry and is used whole; so is an address that is empty
    before its last colon.
    """
    comma = F.instr(forwarded, ",")
    first = F.when(comma > 1, F.substring(forwarded, F.lit(1), comma - 1)).otherwise(forwarded)
    host = F.regexp_replace(address, r"(?s)^(.+):[^:]*\z", "$1")
    return F.when(F.coalesce(forwarded, F.lit("")) != "", trim_space(first)).otherwise(host)
