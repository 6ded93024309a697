"""Signatures: volatile parts of a message replaced by placeholders."""

from __future__ import annotations

from pyspark.sql import DataFrame

# A word boundary counts only ASCII letters, digits and underscore, so it is spelled out: Java's own \b
# also treats accented letters as word characters.  In front of a match it is checked after the first
# character has been seen, which rejects most positions of a text at the lowest cost.
_WORD = "[0-9A-Za-z_]"
_END = f"(?!{_WORD})"
_HEX = "[0-9a-fA-F]"

# The rewrites in the order they apply.  name -> (pattern, placeholder, what a text needs for
# the pattern to be tried at all)
RULES = {
    "uuid": (f"{_HEX}{{8}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{12}}", "<uuid>", "contains({0}, '-')"),
    "request": (
        f"(?=[rst])(?<!{_WORD})(?:req|request|trace|span)[-_=][a-zA-Z0-9]{{8,}}{_END}", "<req>",
        "contains({0}, 'req') OR contains({0}, 'trace') OR contains({0}, 'span')",
    ),
    "ipv6": (
        f"(?:{_HEX}{{1,4}}:){{7}}{_HEX}{{1,4}}|::1(?<={_WORD}::1){_END}", "<ip>",
        "contains({0}, '::1') OR octet_length({0}) - octet_length(replace({0}, ':', '')) >= 7",
    ),
    "ipv4": (rf"\d(?<!{_WORD}\d)\d{{0,2}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}{_END}", "<ip>", "contains({0}, '.')"),
    "hex": (f"0x(?<!{_WORD}0x){_HEX}+{_END}", "<hex>", "contains({0}, '0x')"),
    # A quote is spelled \x27 because the pattern stands inside a quoted SQL literal.
    "path": (r'/[^\t\n\f\r "\x27)\]}:,;]*(?::\d+)?', "<path>", "contains({0}, '/')"),
    "hash": (f"{_HEX}(?<!{_WORD}{_HEX}){_HEX}{{39,}}{_END}", "<hash>", "octet_length({0}) >= 40"),
    "number": (rf"\d(?<!{_WORD}\d)\d*{_END}", "<n>", None),
}


def rewrite(text: str, name: str) -> str:
    """SQL text: one rewrite of a column."""
    pattern, placeholder, need = RULES[name]
    replaced = f"regexp_replace({text}, r'{pattern}', '{placeholder}')"
    return f"CASE WHEN {need.format(text)} THEN {replaced} ELSE {text} END" if need else replaced


def with_signature(df: DataFrame, message: str = "message", name: str = "signature") -> DataFrame:
    """Add the message with all rewrites applied in order; ``message`` is SQL text, null stays null.

    Every rewrite is a column of its own that builds on the one before.
    """
    steps, current = [f"{message} AS _s"], "_s"
    for rule in RULES:
        steps.append(f"{rewrite(current, rule)} AS _s_{rule}")
        current = f"_s_{rule}"
    return df.selectExpr("*", *steps, f"{current} AS {name}").select(*df.columns, name)
