"""Log analytics on Spark DataFrames and Structured Streaming."""

import sys

from pyspark import cloudpickle

from emberlog.session import build_session, scratch_dir, tune_session

# Functions that run in Python workers travel whole, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "scratch_dir", "tune_session"]
