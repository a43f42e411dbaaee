"""The selection language as a tree. Nodes are frozen, so equal parts of an expression are equal objects and compile once."""

from __future__ import annotations

from dataclasses import dataclass


class Node:
    """A set of pages of a document."""


@dataclass(frozen=True)
class All(Node):
    pass


@dataclass(frozen=True)
class Step(Node):
    """Every step-th page from start to stop; an open stop is the last page."""

    start: int = 1
    stop: int | None = None
    step: int = 1


@dataclass(frozen=True)
class Span(Node):
    """Pages start to stop; an open end is the first or the last page. Reverse if start > stop."""

    start: int | None
    stop: int | None

    @property
    def reverse(self) -> bool:
        return self.start is not None and self.stop is not None and self.start > self.stop


@dataclass(frozen=True)
class First(Node):
    count: int


@dataclass(frozen=True)
class Last(Node):
    count: int


@dataclass(frozen=True)
class Match(Node):
    """A predicate on a page: kind is contains, regex, line-starts, type or size."""

    kind: str
    value: str
    ignore_case: bool = False


@dataclass(frozen=True)
class Shift(Node):
    """The pages that lie by after a page of the node (before it, if by is negative)."""

    node: Node
    by: int


@dataclass(frozen=True)
class Not(Node):
    node: Node


@dataclass(frozen=True)
class And(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Or(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Section(Node):
    """From each start page to the nearest end page at or after it."""

    start: Node
    end: Node


@dataclass(frozen=True)
class Argument:
    """One part of a comma list. form: keyword, boolean, range, pattern, numeric, or page for a single number."""

    spec: str
    node: Node
    form: str

    @property
    def is_range(self) -> bool | None:
        """Whether its group counts as a range; None: if it has more than one page."""
        if self.form in ("boolean", "pattern"):
            return None
        return self.form != "page" and not isinstance(self.node, Step)


@dataclass(frozen=True)
class Selection:
    arguments: tuple[Argument, ...]
    preserve_order: bool
