"""Trimmers as column functions: characters, words, lines or numbers cut from the start or the end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import lines, words

NUMBER = r"(?U)\d+(?:[.,]\d+)*"


def trim_one(text: Column, kind: str, count: int, from_start: bool = True) -> Column:
    """What is left; empty if there is no more to cut than that."""
    if kind == "ch":
        left = F.substring(text, F.lit(count + 1), F.length(text)) if from_start else F.substring(text, F.lit(1), F.length(text) - count)
        return F.when(F.length(text) <= count, "").otherwise(left)
    if kind in ("wd", "ln"):
        parts = words(text) if kind == "wd" else lines(text)
        n = F.greatest(F.size(parts) - count, F.lit(0))
        return F.array_join(F.slice(parts, count + 1 if from_start else 1, n), " " if kind == "wd" else "\n")
    numbers, between = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), F.split(text, NUMBER)
    n = F.size(numbers)
    if from_start:  # after the count-th number: what stands between, and each number that follows
        rest = F.zip_with(F.slice(between, F.lit(count + 1), F.greatest(n + 1 - count, F.lit(0))), F.slice(numbers, F.lit(count + 1), F.greatest(n - count, F.lit(0))), _pair)
    else:
        k = n - count
        rest = F.zip_with(F.slice(between, F.lit(1), F.greatest(k + 1, F.lit(0))), F.slice(numbers, F.lit(1), F.greatest(k, F.lit(0))), _pair)
    return F.when(n < count, "").otherwise(F.array_join(rest, ""))


def _pair(between: Column, number: Column) -> Column:
    return F.concat(between, F.coalesce(number, F.lit("")))


def trim(text: Column, start: list[tuple[str, int]] = (), end: list[tuple[str, int]] = ()) -> Column:
    """All trimmers in turn, those of the start first."""
    for kind, count in start:
        text = trim_one(text, kind, count)
    for kind, count in end:
        text = trim_one(text, kind, count, False)
    return text


def trim_warnings(text: Column, trimmers: list[tuple[str, int]]) -> Column:
    """What trimmers of characters, words or lines would leave nothing."""
    has = {"ch": (F.length(text), "characters"), "wd": (F.size(words(text)), "words"), "ln": (F.size(lines(text)), "lines")}
    found = [F.when(has[k][0] <= n, F.format_string(f"trimming {n} {has[k][1]} of %d leaves nothing", has[k][0])) for k, n in trimmers if k in has]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
