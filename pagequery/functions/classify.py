"""Page types and sizes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagequery.errors import SelectionError

from .text import trim_ws

MEANINGFUL, LONG = 50, 200
UNITS = {"": 1, "KB": 1024, "MB": 1024**2, "GB": 1024**3}


def page_type(text: Column, image_count: Column) -> Column:
    """empty, image, text or mixed; text counts from 50 characters on."""
    n, images = F.length(trim_ws(F.coalesce(text, F.lit("")))), F.coalesce(image_count, F.lit(0)) > 0
    return F.when(n >= MEANINGFUL, F.when(images, "mixed").otherwise("text")).otherwise(F.when(images, "image").otherwise("empty"))


def confidence(text: Column, image_count: Column) -> Column:
    """How sure the type is: constants but for mixed pages, which are surer the more text and images balance."""
    n, images = F.length(trim_ws(F.coalesce(text, F.lit("")))), F.coalesce(image_count, F.lit(0))
    balance = 1 - F.abs(F.least(n / 500, F.lit(1.0)) - F.least(images / 5, F.lit(1.0)))
    plain = F.when(n > LONG, 0.95).otherwise(0.85)
    return F.when(n >= MEANINGFUL, F.when(images > 0, 0.75 + 0.20 * balance).otherwise(plain)).otherwise(F.when(images > 0, 0.90).otherwise(0.95))


def parse_size(condition: str) -> tuple[str, int]:
    """(operator, bytes) of '<500KB' and the like; what follows the unit is ignored."""
    m = re.match(r"([<>=]+)\s*(\d+(?:\.\d+)?)\s*(KB|MB|GB)?", condition.strip().upper())
    if not m or m[1] not in ("<", "<=", ">", ">=", "=", "=="):
        raise SelectionError(f"not a size condition: {condition}")
    return m[1], int(float(m[2]) * UNITS[m[3] or ""])


def size_matches(size: Column, condition: str) -> Column:
    """Equal means within 5 % or 1 KB, whichever is more."""
    op, n = parse_size(condition)
    if op in ("=", "=="):
        return F.abs(size - n) <= max(0.05 * n, 1024)
    return {"<": size < n, "<=": size <= n, ">": size > n, ">=": size >= n}[op]


def format_size(size: Column) -> Column:
    """B, KB, MB or GB with one decimal."""
    of = lambda unit: F.concat(F.replace(F.format_number(size / UNITS[unit], 1), F.lit(","), F.lit("")), F.lit(f" {unit}"))
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < UNITS["MB"], of("KB")).when(size < UNITS["GB"], of("MB")).otherwise(of("GB"))
