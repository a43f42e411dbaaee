"""One document's selection from the flags of its pages: what streams and table functions do where a document has come together.

Flags are a boolean for each page and pattern; nothing here reads a text. A page that never came has no flag and is in no group."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

from pagequery.errors import SelectionError
from pagequery.functions.classify import MEANINGFUL, parse_size

from .ast import All, And, Argument, First, Last, Match, Node, Not, Or, Section, Selection, Shift, Span, Step
from .compile import bounds, walk


def leaves(nodes: Iterable[Node]) -> list[Match]:
    """The patterns in trees, each once."""
    return list(dict.fromkeys(x for n in nodes for x in walk(n) if isinstance(x, Match)))


@lru_cache(maxsize=1000)
def compiled(value: str, ignore_case: bool) -> re.Pattern | None:
    try:
        return re.compile(value, re.I if ignore_case else 0)
    except re.error:
        return None


def holds(leaf: Match, text: str | None, image_count: int | None, size_bytes: int | None) -> bool:
    """A pattern on a page, where no column can be used."""
    text, value = text or "", leaf.value
    fold = str.lower if leaf.ignore_case else str
    if leaf.kind == "type":
        images, long = (image_count or 0) > 0, len(text.strip()) >= MEANINGFUL
        return value.lower() == (("mixed" if images else "text") if long else "image" if images else "empty")
    if leaf.kind == "size":
        if size_bytes is None:
            return False
        op, n = parse_size(value)
        return abs(size_bytes - n) <= max(0.05 * n, 1024) if op in ("=", "==") else {"<": size_bytes < n, "<=": size_bytes <= n, ">": size_bytes > n, ">=": size_bytes >= n}[op]
    if not text:
        return False
    if leaf.kind == "contains":
        return fold(value) in fold(text)
    if leaf.kind == "line-starts":
        return any(fold(x.strip()).startswith(fold(value)) for x in text.split("\n"))
    found = compiled(value, leaf.ignore_case)
    return bool(found and found.search(text))


class Document:
    """flags: page number -> a flag for each of the leaves, in their order."""

    def __init__(self, flags: dict[int, Iterable[bool]], of: list[Match]):
        self.n = max(flags, default=0)
        self.here = np.zeros(self.n + 1, bool)  # place 0 is no page
        table = np.zeros((len(of), self.n + 1), bool)
        for page, x in flags.items():
            self.here[page] = True
            table[:, page] = list(x)
        self.flags = dict(zip(of, table, strict=True))
        self.pages = np.arange(self.n + 1)

    def member(self, node: Node) -> np.ndarray:
        """Whether each page is in the node's set."""
        page, here = self.pages, self.here
        if isinstance(node, Match):
            return self.flags[node] & here
        if isinstance(node, All):
            return here
        if isinstance(node, Span):
            low, high = (node.stop, node.start) if node.reverse else (node.start, node.stop)
            return here & (page >= (1 if low is None else low)) & (page <= (self.n if high is None else high))
        if isinstance(node, Step):
            return here & (page >= node.start) & ((page - node.start) % node.step == 0) & (page <= (self.n if node.stop is None else node.stop))
        if isinstance(node, First):
            return here & (page <= node.count)
        if isinstance(node, Last):
            return here & (page > self.n - node.count)
        if isinstance(node, Not):
            return here & ~self.member(node.node)
        if isinstance(node, And):
            return self.member(node.left) & self.member(node.right)
        if isinstance(node, Or):
            return self.member(node.left) | self.member(node.right)
        if isinstance(node, Shift):
            out, of = np.zeros_like(here), np.nonzero(self.member(node.node))[0] + node.by
            out[of[(of >= 1) & (of <= self.n)]] = True
            return out & here
        if isinstance(node, Section):
            out = np.zeros(self.n + 2, np.int64)
            for start, end in self.sections(node):
                out[start] += 1
                out[end + 1] -= 1
            return here & (np.cumsum(out)[: self.n + 1] > 0)
        raise SelectionError(f"no value for {node}")

    def sections(self, node: Section) -> list[tuple[int, int]]:
        """The start pages that have one, with the nearest end at or after them."""
        starts, ends = (np.nonzero(self.member(x))[0] for x in (node.start, node.end))
        at = np.searchsorted(ends, starts)
        return [(int(s), int(ends[i])) for s, i in zip(starts, at, strict=True) if i < len(ends)]

    def is_valid(self, a: Argument) -> bool:
        if isinstance(a.node, Section):
            return bool(self.sections(a.node))
        needed = bounds(a.node) if a.form in ("numeric", "page") else []
        return not needed or (min(needed) >= 1 and max(needed) <= self.n)

    def rows(self, selection: Selection, on_error: str = "skip") -> Iterator[tuple]:
        """(group_ix, pos, page_no, spec, is_range, preserve_order), as the compiled selection has them."""
        valid = [self.is_valid(a) for a in selection.arguments]
        if on_error == "skip" and not all(valid):
            return
        number = 1
        for a, ok in zip(selection.arguments, valid, strict=True):
            if isinstance(a.node, Section):
                found = self.sections(a.node)
                for i, (start, end) in enumerate(found, 1):
                    for page in range(start, end + 1):
                        if self.here[page]:
                            yield number, page, page, f"{a.spec} (section {i})", True, selection.preserve_order
                    number += 1
                continue
            if ok:
                pages = np.nonzero(self.member(a.node))[0].tolist()
                is_range = len(pages) > 1 if a.is_range is None else a.is_range
                back = isinstance(a.node, Span) and a.node.reverse
                for page in pages:
                    yield number, -page if back else page, page, a.spec, is_range, selection.preserve_order
            number += 1

    def split(self, rows: Iterable[tuple], start: Node | None, end: Node | None) -> Iterator[tuple]:
        """Groups split where a page opens or closes one, numbered and named anew."""
        opens, closes = (self.member(x) if x else np.zeros(self.n + 1, bool) for x in (start, end))
        parts, group, before = [], None, 0
        for row in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
            if row[0] != group or opens[row[2]] or closes[before]:
                parts.append([])
            group, before = row[0], row[2]
            parts[-1].append(row[2])
        for number, pages in enumerate(parts, 1):
            low, high, n = min(pages), max(pages), len(pages)
            spec = f"page{low}" if n == 1 else f"pages{low}-{high}" if high - low + 1 == n else "pages" + ",".join(map(str, sorted(pages)))
            for page in pages:
                yield number, page, page, spec, n > 1, False


def first_listings(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Each page once, in its first group."""
    seen = set()
    for row in sorted(rows, key=lambda r: (r[0], r[1])):
        if row[2] not in seen:
            seen.add(row[2])
            yield row
