"""From trees to plans.

Predicates on a page become boolean columns of one projection, so text never enters a shuffle. What looks beyond a page (the
number of pages, offsets, sections) becomes windows: over documents, with one exchange whatever the expression, or, for documents
of any size, over ranges of ``each`` pages in two levels (``windows``).
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pagequery.errors import SelectionError
from pagequery.functions.classify import page_type, size_matches
from pagequery.functions.text import java_regex, lines, trim_ws

from .ast import All, And, Argument, First, Last, Match, Node, Not, Or, Section, Selection, Shift, Span, Step
from .windows import ByDocument, ByRange


def predicate(node: Match) -> Column:
    """The column of a page predicate; never null, false on empty text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    value = node.value
    if node.kind == "contains":
        found = F.contains(F.lower(text), F.lit(value.lower())) if node.ignore_case else F.contains(text, F.lit(value))
    elif node.kind == "regex":
        pattern = java_regex(value, node.ignore_case)
        if pattern is None:
            warnings.warn(f"not a regular expression, matches nothing: {value}", stacklevel=2)
            return F.lit(False)
        found = text.rlike(pattern)
    elif node.kind == "line-starts":
        fold = F.lower if node.ignore_case else lambda c: c
        start = value.lower() if node.ignore_case else value
        found = F.exists(lines(text), lambda x: F.startswith(fold(trim_ws(x)), F.lit(start)))
    elif node.kind == "type":
        return page_type(F.col("text"), F.col("image_count")) == value.lower()
    else:
        return F.coalesce(size_matches(F.col("size_bytes"), value), F.lit(False))
    return F.coalesce((text != "") & found, F.lit(False))


def walk(node: Node) -> Iterator[Node]:
    yield node
    for part in vars(node).values():
        if isinstance(part, Node):
            yield from walk(part)


def bounds(node: Node) -> list[int]:
    """The page numbers that a document must have for a numeric argument to hold."""
    if isinstance(node, Span):
        return [x for x in (node.start, node.stop) if x is not None]
    if isinstance(node, Step):
        return [] if (node.start, node.stop) in ((1, None), (2, None)) else [x for x in (node.start, node.stop) if x is not None]
    return []


def needs_document(node: Node) -> bool:
    """Whether a page alone does not tell if it is in the node's set."""
    return any(isinstance(x, (Last, Section, Shift)) for x in walk(node))


class Plan:
    """A page relation with a column for each node that was asked for. each: pages a range, if documents are cut into ranges."""

    def __init__(self, pages: DataFrame, nodes: list[Node], keep: tuple[str, ...] = (), each: int | None = None):
        matches = list(dict.fromkeys(x for n in nodes for x in walk(n) if isinstance(x, Match)))
        self.columns: dict[object, Column] = {m: F.col(f"__m{i}") for i, m in enumerate(matches)}
        flags = pages.select("doc_id", "page_no", *keep, *(predicate(m).alias(f"__m{i}") for i, m in enumerate(matches)))
        self.windows = ByRange(flags, each) if each else ByDocument(flags)
        self.made = 0

    @property
    def df(self) -> DataFrame:
        return self.windows.df

    def add(self, key: object, how, *of) -> Column:
        """The column that a method of the windows adds for a key, made once."""
        if key not in self.columns:
            name = f"__w{self.made}"
            self.made += 1
            how(name, *of)
            self.columns[key] = F.col(name)
        return self.columns[key]

    @property
    def n(self) -> Column:
        """The document's number of pages."""
        return self.add("n", self.windows.highest, F.col("page_no"))

    def section_end(self, node: Section) -> Column:
        """On a start page that has one, the nearest end page at or after it; else null."""
        key = ("end", node)
        if key not in self.columns:
            start, end = self.column(node.start), self.column(node.end)
            nearest = self.add(("nearest", node.end), self.windows.least_ahead, F.when(end, F.col("page_no")))
            self.add(key, self.windows.add, F.when(start, nearest))
        return self.columns[key]

    def column(self, node: Node) -> Column:
        """Whether a page is in the node's set."""
        page = F.col("page_no")
        if node in self.columns:
            return self.columns[node]
        if isinstance(node, All):
            return F.lit(True)
        if isinstance(node, Span):
            low, high = (node.stop, node.start) if node.reverse else (node.start, node.stop)
            low = 1 if low is None else low
            return (page >= low) if high is None else page.between(low, high)
        if isinstance(node, Step):
            inside = (page >= node.start) & ((page - node.start) % node.step == 0)
            return inside if node.stop is None else inside & (page <= node.stop)
        if isinstance(node, First):
            return page <= node.count
        if isinstance(node, Last):
            return page > self.n - node.count
        if isinstance(node, Not):
            return ~self.column(node.node)
        if isinstance(node, And):
            return self.column(node.left) & self.column(node.right)
        if isinstance(node, Or):
            return self.column(node.left) | self.column(node.right)
        if isinstance(node, Shift):
            of = self.column(node.node)
            return self.add(node, self.windows.shifted, of, node.by)
        if isinstance(node, Section):
            # the end of a later start is never before that of an earlier one, so the last one seen decides
            end = self.section_end(node)
            latest = self.add(("latest", node), self.windows.latest, end)
            return self.add(node, self.windows.add, F.coalesce(latest >= page, F.lit(False)))
        raise SelectionError(f"no plan for {node}")

    def holds(self, argument: Argument) -> Column | None:
        """Whether the argument is valid in the document; None: in any."""
        if isinstance(argument.node, Section):
            end = self.section_end(argument.node)
            return self.add(("pairs", argument.node), self.windows.total, end.isNotNull().cast("int")) > 0
        if argument.form in ("numeric", "page") and (needed := bounds(argument.node)):
            return F.lit(min(needed) >= 1) & (self.n >= max(needed))
        return None


def page_set(pages: DataFrame, node: Node, keep: tuple[str, ...] = (), each: int | None = None) -> DataFrame:
    """doc_id, page_no (and keep) of the pages in the node's set: no shuffle unless it looks beyond a page."""
    plan = Plan(pages, [node], keep, each if needs_document(node) else None)
    member = plan.column(node)
    return plan.df.where(member).select("doc_id", "page_no", *keep)


GROUP_COLUMNS = ("doc_id", "group_ix", "pos", "page_no", "spec", "is_range", "preserve_order")


def select(pages: DataFrame, selection: Selection, on_error: str = "skip", each: int | None = None, observation: Observation | None = None) -> DataFrame:
    """The selection relation: a row for each page of each group, in the order of (doc_id, group_ix, pos).

    Groups are numbered from 1 by their argument, a range pattern has one for each section, and an argument without a page keeps
    its number. on_error: 'skip' leaves out documents that some argument is invalid in, 'ignore' only that argument, 'raise' is
    an error (and costs an action). observation: counts, in the job that writes the rows, the documents and those that an argument is invalid in
    (which ones and why: ``arguments.problems``)."""
    if on_error not in ("skip", "ignore", "raise"):
        raise SelectionError(f"unknown on_error: {on_error}")
    plan = Plan(pages, [a.node for a in selection.arguments], each=each)
    page, valid, rows, base = F.col("page_no"), [], [], F.lit(1)
    row_type = "array<struct<group_ix:int,pos:int,page_no:int,spec:string,is_range:boolean>>"
    for k, a in enumerate(selection.arguments):
        if (holds := plan.holds(a)) is not None:
            valid.append(holds)
        ignored = holds if on_error == "ignore" and holds is not None and not isinstance(a.node, Section) else F.lit(True)
        if isinstance(a.node, Section):
            end = plan.section_end(a.node)
            number = plan.add(("number", k, a.node), plan.windows.running, end.isNotNull().cast("int"))
            group, spec = (base + number - 1).cast("int"), F.concat(F.lit(f"{a.spec} (section "), number.cast("string"), F.lit(")"))
            made = _section_rows(page, end, group, spec)
            rows.append(F.when(end.isNotNull(), made).otherwise(F.array().cast(row_type)).cast(row_type))
            base = base + plan.columns["pairs", a.node]
        else:
            member = plan.column(a.node) & ignored
            is_range = F.lit(a.is_range) if a.is_range is not None else plan.add(("size", a.node), plan.windows.total, member.cast("int")) > 1
            pos = -page if isinstance(a.node, Span) and a.node.reverse else page
            one = F.struct(base.cast("int").alias("group_ix"), pos.cast("int").alias("pos"), page.cast("int").alias("page_no"), F.lit(a.spec).alias("spec"), is_range.alias("is_range"))
            rows.append(F.when(member, F.array(one)).otherwise(F.array().cast(row_type)).cast(row_type))
            base = base + 1
    df, bad = plan.df, F.lit(False)
    for v in valid:
        bad = bad | ~v
    if observation is not None:
        first = F.col("page_no") == 1
        df = df.observe(observation, F.count_if(first).alias("documents"), F.count_if(first & bad).alias("invalid"))
    if valid and on_error != "ignore":
        if on_error == "raise":
            if first := df.where(bad).select("doc_id").first():
                raise SelectionError(f"the expression is invalid in document {first[0]}")
        else:
            df = df.where(~bad)
    out = df.select("doc_id", F.explode(rows[0] if len(rows) == 1 else F.concat(*rows)).alias("r")).select("doc_id", "r.*")
    return out.withColumn("preserve_order", F.lit(selection.preserve_order)).select(*GROUP_COLUMNS)


def _section_rows(page: Column, end: Column, group: Column, spec: Column) -> Column:
    def row(p: Column) -> Column:
        return F.struct(group.alias("group_ix"), p.cast("int").alias("pos"), p.cast("int").alias("page_no"), spec.alias("spec"), F.lit(True).alias("is_range"))

    return F.transform(F.sequence(page, end), row)
