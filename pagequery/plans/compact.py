"""Extraction patterns: the compact syntax [variable=]keyword:moves type count flags ^trim $trim pg… mt…, and the four-part one."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

from pagequery.errors import PatternError

from .template import auto_variable_name, validate_variable
from .trimmers import parse_trimmers

OPPOSITE = {"u": "d", "d": "u", "l": "r", "r": "l"}


@dataclass(frozen=True)
class Pick:
    """Which pages or matches: all, single (a), last (a), from (a) or range (a to b)."""

    kind: str
    a: int = 0
    b: int = 0

    def bounds(self, n: int) -> tuple[int, int]:
        """First and last of n, from 1; empty if the first is larger."""
        return {"all": (1, n), "single": (self.a, self.a if self.a <= n else 0), "last": (max(1, n - self.a + 1), n), "from": (self.a, n), "range": (self.a, min(self.b, n))}[self.kind]


@dataclass(frozen=True)
class Pattern:
    variable: str
    keyword: str
    moves: tuple[tuple[str, int], ...]
    kind: str
    count: int
    flexible: bool = False
    no_spaces: bool = False
    start: tuple[tuple[str, int], ...] = field(default=())
    end: tuple[tuple[str, int], ...] = field(default=())
    pages: Pick | None = None
    matches: Pick | None = None


def parse_pick(text: str) -> Pick:
    """N, N-M, N-, -N (the last N) or 0 (all)."""
    if text == "0":
        return Pick("all")
    if m := re.fullmatch(r"(\d+)", text):
        return Pick("single", int(m[1]))
    if m := re.fullmatch(r"(\d+)-(\d*)", text):
        a = int(m[1])
        if a < 1 or (m[2] and int(m[2]) < a):
            raise PatternError(f"not an ascending range from 1: '{text}'")
        return Pick("range", a, int(m[2])) if m[2] else Pick("from", a)
    if (m := re.fullmatch(r"-(\d+)", text)) and int(m[1]) >= 1:
        return Pick("last", int(m[1]))
    raise PatternError(f"not a range: '{text}'")


class Reader:
    """A specification that is read from left to right."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def take(self, *marks: str) -> str | None:
        """The mark that comes next, if it is one of these."""
        found = next((m for m in marks if self.text.startswith(m, self.at)), None)
        self.at += len(found or "")
        return found

    def run(self, allowed: str, most: int | None = None) -> str:
        """As many of the allowed characters as come next."""
        start = self.at
        while self.at < len(self.text) and self.text[self.at] in allowed and (most is None or self.at - start < most):
            self.at += 1
        return self.text[start : self.at]

    def number(self, most: int) -> int:
        digits = self.run("0123456789", most)
        if not digits:
            raise PatternError(f"a number is missing at {self.at} of '{self.text}'")
        return int(digits)


def read_moves(reader: Reader) -> tuple[tuple[str, int], ...]:
    """Up to two moves that do not undo one another."""
    moves = []
    while reader.text[reader.at + 1 : reader.at + 2].isdecimal() and (direction := reader.take(*OPPOSITE)):
        moves.append((direction, reader.number(2)))
    if len(moves) > 2 or (len(moves) == 2 and OPPOSITE[moves[0][0]] == moves[1][0]):
        raise PatternError(f"too many moves, or such that undo one another, in '{reader.text}'")
    return tuple(moves)


def read_trimmers(reader: Reader, mark: str) -> tuple[tuple[str, int], ...]:
    return tuple(parse_trimmers(reader.run("wdlnbch0123456789"))) if reader.take(mark) else ()


def read_pick(reader: Reader, mark: str) -> Pick | None:
    return parse_pick(reader.run("0123456789-")) if reader.take(mark) else None


def parse_pattern(text: str) -> Pattern:
    text = text.strip()
    name, eq, rest = text.partition("=")
    if eq and not validate_variable(name.strip())[0]:
        raise PatternError(f"{text}: {validate_variable(name.strip())[1]}")
    keyword, colon, spec = (rest if eq else text).rpartition(":")
    keyword = keyword.strip().strip("\"'")
    if not colon or not keyword:
        raise PatternError(f"a pattern is keyword:specification, not '{text}'")
    reader = Reader(spec.strip())
    moves = read_moves(reader)
    kind = reader.take("wd", "ln", "nb")
    if kind is None:
        raise PatternError(f"wd, ln or nb is missing in '{text}'")
    count, flags = reader.number(2), reader.run("_-")
    trims = [read_trimmers(reader, mark) for mark in "^$"]
    picks = [read_pick(reader, mark) for mark in ("pg", "mt")]
    if reader.at < len(reader.text):
        raise PatternError(f"cannot read '{reader.text[reader.at :]}' in '{text}'")
    return Pattern(name.strip() if eq else auto_variable_name(keyword), keyword, moves, kind, count, "-" in flags, "_" in flags, *trims, *picks)


def parse_patterns(texts: list[str]) -> list[Pattern]:
    out = [parse_pattern(t) for t in texts]
    twice = {v for v, n in Counter(p.variable for p in out).items() if n > 1}
    if twice:
        raise PatternError(f"variables that occur twice: {', '.join(sorted(twice))}")
    return out


def read_pattern_file(path: str) -> list[str]:
    """One pattern a line; blank lines and # comments are skipped."""
    with open(path, encoding="utf-8") as f:
        return [x for x in map(str.strip, f) if x and not x.startswith("#")]


# --- the four-part syntax ---------------------------------------------------------------------------------------------

DIRECTIONS = ("left", "right", "above", "below")
KINDS = ("word", "line", "number", "text")


@dataclass(frozen=True)
class LegacyPattern:
    keyword: str
    direction: str
    distance: int
    kind: str


def parse_legacy(text: str) -> LegacyPattern:
    """keyword:direction:distance:type"""
    parts = text.strip().split(":")
    if len(parts) != 4 or not parts[0] or not parts[2].strip().lstrip("-").isdigit():
        raise PatternError(f"a pattern is keyword:direction:distance:type, not '{text}'")
    keyword, direction, distance, kind = parts[0], parts[1].strip().lower(), int(parts[2]), parts[3].strip().lower()
    if direction not in DIRECTIONS or kind not in KINDS:
        raise PatternError(f"unknown direction or type in '{text}'")
    return LegacyPattern(keyword, direction, distance, kind)


def read_legacy_file(path: str) -> list[LegacyPattern] | None:
    """All patterns of a file, or None if one cannot be read."""
    try:
        return [parse_legacy(x) for x in read_pattern_file(path)]
    except PatternError:
        return None


def as_compact(p: LegacyPattern) -> Pattern:
    """The compact pattern that stands for a four-part one."""
    move = {"above": "u", "below": "d", "left": "l", "right": "r"}[p.direction]
    kind, count = {"word": ("wd", 1), "text": ("wd", 0), "line": ("ln", 1), "number": ("nb", 1)}[p.kind]
    return Pattern(auto_variable_name(p.keyword), p.keyword, ((move, p.distance),), kind, count)
