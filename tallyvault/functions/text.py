"""Name patterns with one meaning in both engines: RE2's syntax, unanchored, by code point."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyvault.errors import InvalidFilter

_LOOKAROUND = re.compile(r"(?<!\\)\((?:\?[=!]|\?<[=!]|\?>)")
_BACK = re.compile(r"(?<!\\)(?:\\\\)*\\[1-9k]")
_POSSESSIVE = re.compile(r"(?<!\\)[*+?}]\+")


def checked(pattern: str) -> str:
    """The pattern, if both engines take it alike; lookaround, back references and possessive counts are refused."""
    if _LOOKAROUND.search(pattern) or _BACK.search(pattern) or _POSSESSIVE.search(pattern):
        raise InvalidFilter("the pattern uses what regular languages do not have")
    try:
        re.compile(pattern)
    except re.error as e:
        raise InvalidFilter(f"the pattern cannot be read: {e}") from e
    return pattern


def _end_only(pattern: str) -> str:
    """`$` as the end of the text alone: not, as in Java, before a last line break too."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        inside = c == "[" or (inside and c != "]")
        out.append(r"\z" if c == "$" and not inside else c)
        i += 1
    return "".join(out)


def matches(column: Column, pattern: str, case_sensitive: bool) -> Column:
    """Only line feeds are line breaks, and case is folded over all of Unicode."""
    return column.rlike(("(?d)" if case_sensitive else "(?diu)") + _end_only(checked(pattern)))


def glob(value: str) -> str:
    """`*` and `?` as in file names; everything else stands for itself, from end to end."""
    parts = {"*": ".*", "?": "."}
    return "^" + "".join(parts.get(c) or (c if c.isalnum() or c == "_" or ord(c) > 127 else "\\" + c) for c in value) + "$"


def named(column: Column, value: str, how: str, case_sensitive: bool) -> Column:
    """A name predicate: CONTAINS, STARTS_WITH, ENDS_WITH, EXACT, REGEX or GLOB."""
    if how in ("REGEX", "GLOB"):
        return matches(column, value if how == "REGEX" else glob(value), case_sensitive)
    a, b = (column, F.lit(value)) if case_sensitive else (F.lower(column), F.lower(F.lit(value)))
    test = {"CONTAINS": a.contains, "STARTS_WITH": a.startswith, "ENDS_WITH": a.endswith, "EXACT": a.__eq__}
    if how not in test:
        raise InvalidFilter(f"unknown name match {how}")
    return test[how](b)


def digest(column: Column) -> Column:
    """Whether a text is a SHA-256 in lower-case hexadecimal."""
    return column.rlike(r"\A[0-9a-f]{64}\z")
