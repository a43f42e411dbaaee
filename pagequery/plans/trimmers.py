"""Trimmer blocks: 'wd1ch5nb2'."""

from __future__ import annotations

import re

from pagequery.errors import PatternError

PART = re.compile(r"(wd|ln|nb|ch)(\d{1,3})")


def parse_trimmers(block: str) -> list[tuple[str, int]]:
    if not re.fullmatch(f"(?:{PART.pattern})+", block):
        raise PatternError(f"not a trimmer block: '{block}'")
    out = [(kind, int(n)) for kind, n in PART.findall(block)]
    if any(n == 0 for _, n in out):
        raise PatternError(f"a trimmer of zero: '{block}'")
    return out
