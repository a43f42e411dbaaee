"""The engine's front: PageQuery(pages).select(expr).split(...).keep(...).dedup(...).pages()"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation

from pagequery.operators import analysis, groups
from pagequery.plans import arguments
from pagequery.plans import compile as plans
from pagequery.plans.ast import Section
from pagequery.plans.parser import parse, parse_argument
from pagequery.plans.reuse import PageSets
from pagequery.sources import sinks


TABLE_FROM = 64


class Selected:
    """Groups of pages; each step gives a new one."""

    def __init__(self, pages: DataFrame, rows: DataFrame, description: str = "", range_pages: int | None = None):
        self.source, self.rows, self.description, self.range_pages = pages, rows, description, range_pages

    def _with(self, rows: DataFrame) -> Selected:
        return Selected(self.source, rows, self.description, self.range_pages)

    def split(self, start: str | None = None, end: str | None = None) -> Selected:
        return self._with(groups.split_at(self.rows, self.source, start, end, self.range_pages))

    def keep(self, criteria: str | None) -> Selected:
        return self._with(groups.keep_groups(self.rows, self.source, criteria, self.range_pages))

    def followed_by(self, other: Selected) -> Selected:
        """The groups of both, the other's behind these in each document."""
        return self._with(groups.merged(self.rows, other.rows))

    def dedup(self, strategy: str = "strict") -> Selected:
        return self._with(groups.dedup(self.rows, strategy))

    def groups(self) -> DataFrame:
        return groups.nested(groups.with_order(self.rows))

    def pages(self, strategy: str = "strict") -> DataFrame:
        return groups.ordered_pages(self.rows, strategy, self.range_pages)

    def unselected(self) -> DataFrame:
        return groups.unselected(self.source, self.rows)

    def contents(self, strategy: str = "strict") -> DataFrame:
        """The pages in their order with their columns."""
        return self.pages(strategy).join(self.source, ["doc_id", "page_no"])


class PageQuery:
    """Queries on pages(doc_id, page_no, text, image_count, size_bytes).

    range_pages: documents are cut into ranges of so many pages and scanned in two levels, so that one may hold any share of a collection;
    without it a document's windows run in one task, with fewer joins."""

    def __init__(self, pages: DataFrame, base_dir: str | None = None, on_error: str = "skip", range_pages: int | None = None):
        self.source, self.base_dir, self.on_error, self.range_pages = pages, base_dir, on_error, range_pages

    def select(self, expression: str, observation: Observation | None = None) -> Selected:
        """The groups of an expression. With more than ``TABLE_FROM`` arguments these are a table, so that the plan does not grow with them."""
        tree = parse(expression, self.base_dir)
        if len(tree.arguments) > TABLE_FROM and observation is None and not any(isinstance(a.node, Section) for a in tree.arguments):
            rows = arguments.select_table(self.source, tree, self.on_error, self.range_pages)
        else:
            rows = plans.select(self.source, tree, self.on_error, self.range_pages, observation)
        return Selected(self.source, rows, expression, self.range_pages)

    def problems(self, expression: str) -> DataFrame:
        """doc_id, argument, spec, reason: why documents are left out of a selection."""
        return arguments.problems(self.source, parse(expression, self.base_dir), self.range_pages)

    def analyze(self) -> DataFrame:
        """Type, size and text of each page."""
        return analysis.analyze(self.source)

    def split_pages(self) -> DataFrame:
        """One output a page, of documents with more than one."""
        return sinks.split_to_pages(self.source)

    def outputs(self, selected: Selected, mode: str = "single", strategy: str | None = None) -> DataFrame:
        """The pages of a selection by output: one a document (single), group (grouped) or page (separate)."""
        return sinks.outputs(selected.rows, self.source, mode, strategy)

    def kept(self, folder: str | None = None) -> PageSets:
        """Page sets that are kept and read again."""
        return PageSets(self.source, folder, self.range_pages)

    def where(self, expression: str, keep: tuple[str, ...] = ()) -> DataFrame:
        """The set of pages of one argument: a filter, without a shuffle unless it looks beyond a page."""
        return plans.page_set(self.source, parse_argument(expression).node, keep, self.range_pages)

    def query(self, expression: str, group_start: str | None = None, group_end: str | None = None, filter_matches: str | None = None, dedup: str | None = None) -> Selected:
        """All steps of a selection, in their order."""
        out = self.select(expression).split(group_start, group_end).keep(filter_matches)
        return out.dedup(groups.default_strategy(dedup))
