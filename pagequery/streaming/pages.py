"""The parts of the engine that look at one page at a time, on streams of pages: selections, classification and extraction.

What looks beyond a page (offsets, sections, last N) needs whole documents and is refused here: ``documents.selection_stream`` keeps
state for it. Groups by time use Spark's own watermarks and windows on what these functions give."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pagequery.errors import SelectionError
from pagequery.operators.analysis import analyze
from pagequery.operators.extract import legacy_value, matches
from pagequery.plans.ast import Last, Section, Shift
from pagequery.plans.compact import LegacyPattern, Pattern
from pagequery.plans.compile import page_set, walk
from pagequery.plans.parser import parse_argument


def select_stream(pages: DataFrame, expression: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, page_no (and keep) of the pages of one argument."""
    node = parse_argument(expression).node
    if any(isinstance(x, (Last, Section, Shift)) for x in walk(node)):
        raise SelectionError(f"needs whole documents, so selection_stream: {expression}")
    return page_set(pages, node, keep)


def classify_stream(pages: DataFrame) -> DataFrame:
    return analyze(pages)


def match_stream(pages: DataFrame, patterns: list[Pattern]) -> DataFrame:
    return matches(pages, patterns)


def scrape_stream(pages: DataFrame, patterns: dict[str, LegacyPattern]) -> DataFrame:
    from pyspark.sql import functions as F

    return pages.select("doc_id", "page_no", *(legacy_value(F.col("text"), p).alias(n) for n, p in patterns.items()))
