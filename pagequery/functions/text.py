"""Text as the language sees it: Python's idea of white space, words and lines, in built-in column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What str.split() and str.strip() take for white space (fixed values).
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = f"[{SPACE}]+"


def trim_ws(text: Column) -> Column:
    """str.strip()"""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def words(text: Column) -> Column:
    """str.split()"""
    return F.array_remove(F.split(text, SPACES), "")


def lines(text: Column) -> Column:
    """str.split on line feeds"""
    return F.split(text, "\n")


def collapse(text: Column) -> Column:
    """Words joined by one space"""
    return F.array_join(words(text), " ")


def clean_text(text: Column) -> Column:
    """White space of each line collapsed, blank lines dropped."""
    return F.array_join(F.array_remove(F.transform(lines(text), collapse), ""), "\n")


def non_blank_lines(text: Column) -> Column:
    return F.filter(lines(text), lambda x: trim_ws(x) != "")


def join_or_null(parts: Column, separator: str) -> Column:
    """The parts joined; null where there is none."""
    return F.when(F.size(parts) > 0, F.array_join(parts, separator))


def java_regex(pattern: str, ignore_case: bool = False) -> str | None:
    """A Python pattern for the JVM: Unicode classes, and names of groups; None if Python cannot compile it."""
    try:
        re.compile(pattern)
    except re.error:
        return None
    pattern = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern)
    pattern = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern)
    return ("(?Uiu)" if ignore_case else "(?U)") + pattern
