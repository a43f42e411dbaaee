"""The engine from SQL: views of page relations, and table functions for matches and selections.

    register(spark)
    SELECT m.* FROM pages p, LATERAL keyword_matches(p.text, 'Amount:r1nb1') m
    SELECT * FROM page_select(TABLE(pages), 'contains:"Chapter" to contains:"Summary",last 2')
    SELECT * FROM text_values(TABLE(pages), 'Amount:r1nb1pg0mt-1')
    SELECT s.* FROM (SELECT doc_id, array_sort(collect_list(struct(page_no, text))) AS d FROM pages GROUP BY doc_id) t, LATERAL text_fields(t.d, 'Amount:r1nb1') s

page_select and text_values take a table of pages, which they have dealt out by document and put in order of pages themselves (``analyze``). They read a page at a
time and keep flags, or matches, of the document, never its texts; so a document is nowhere an array.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from pagequery.errors import SelectionError
from pagequery.operators.extract import MATCH, page_matches, phrases_of
from pagequery.plans.compact import Pick, parse_pattern
from pagequery.plans.evaluate import Document, first_listings, holds, leaves
from pagequery.plans.parser import parse
from pagequery.plans.parser import parse_pattern as parse_page_pattern


def of_documents(pages: AnalyzeArgument, needed: set[str], *columns: StructField) -> AnalyzeResult:
    """The result's columns behind doc_id; the table comes by document, pages in order."""
    if not pages.isTable:
        raise SelectionError("the first argument is a table of pages: TABLE(pages)")
    names = {f.name for f in pages.dataType}
    if missing := needed - names:
        raise SelectionError(f"the table lacks {', '.join(sorted(missing))}")
    return AnalyzeResult(StructType([StructField("doc_id", pages.dataType["doc_id"].dataType), *columns]), partitionBy=[PartitioningColumn("doc_id")], orderBy=[OrderingColumn("page_no")])


def constant(argument: AnalyzeArgument | None, what: str) -> str | None:
    if argument is None:
        return None
    if not argument.isConstantExpression:
        raise SelectionError(f"{what} is a constant")
    return argument.value


@udtf
class PageSelect:
    """The selection relation of pages(doc_id, page_no, text[, image_count, size_bytes]); documents that an argument is invalid in are left out.

    Options: group_start and group_end split groups, dedup keeps the first listing of a page."""

    @staticmethod
    def analyze(pages: AnalyzeArgument, expression: AnalyzeArgument, group_start: AnalyzeArgument | None = None, group_end: AnalyzeArgument | None = None, dedup: AnalyzeArgument | None = None) -> AnalyzeResult:
        parse(constant(expression, "the expression") or "")
        for x, what in ((group_start, "group_start"), (group_end, "group_end")):
            if value := constant(x, what):
                parse_page_pattern(value)
        integers = [StructField(x, IntegerType()) for x in ("group_ix", "pos", "page_no")]
        return of_documents(pages, {"doc_id", "page_no", "text"}, *integers, StructField("spec", StringType()), StructField("is_range", BooleanType()), StructField("preserve_order", BooleanType()))

    def __init__(self):
        self.flags, self.doc_id, self.asked = {}, None, None

    def eval(self, pages: Row, expression: str, group_start: str | None = None, group_end: str | None = None, dedup: bool = False):
        if self.asked is None:
            self.selection = parse(expression)
            self.ends = [parse_page_pattern(x) if x else None for x in (group_start, group_end)]
            self.leaves = leaves([*(a.node for a in self.selection.arguments), *filter(None, self.ends)])
            self.asked, self.doc_id = bool(dedup), pages["doc_id"]
            self.known = set(pages.__fields__)
        more = [pages[x] if x in self.known else None for x in ("image_count", "size_bytes")]
        self.flags[pages["page_no"]] = [holds(m, pages["text"], *more) for m in self.leaves]

    def terminate(self) -> Iterator[tuple]:
        if self.asked is None:
            return
        document = Document(self.flags, self.leaves)
        rows = document.rows(self.selection)
        if any(self.ends):
            rows = document.split(rows, *self.ends)
        for row in first_listings(rows) if self.asked else rows:
            yield (self.doc_id, *row)


@udtf
class TextValues:
    """doc_id, variable, page_no, value: the contents that a compact pattern takes from pages(doc_id, page_no, text)."""

    @staticmethod
    def analyze(pages: AnalyzeArgument, pattern: AnalyzeArgument) -> AnalyzeResult:
        parse_pattern(constant(pattern, "the pattern") or "")
        return of_documents(pages, {"doc_id", "page_no", "text"}, StructField("variable", StringType()), StructField("page_no", IntegerType()), StructField("value", StringType()))

    def __init__(self):
        self.pattern, self.found, self.last, self.doc_id = None, [], 0, None

    def eval(self, pages: Row, pattern: str):
        if self.pattern is None:
            self.pattern, self.doc_id = parse_pattern(pattern), pages["doc_id"]
            self.phrases = phrases_of((self.pattern.keyword,))
        self.last = max(self.last, pages["page_no"])
        self.found += [(pages["page_no"], m[4]) for m in page_matches(pages["text"], [self.pattern], self.phrases)]

    def terminate(self) -> Iterator[tuple]:
        if self.pattern is None:
            return
        low, high = (self.pattern.pages or Pick("single", 1)).bounds(self.last)
        found = [x for x in self.found if low <= x[0] <= high]
        first, last = (self.pattern.matches or Pick("single", 1)).bounds(len(found))
        for page_no, value in found[first - 1 : last]:
            yield self.doc_id, self.pattern.variable, page_no, value


@udtf(returnType=MATCH)
class KeywordMatches:
    """The matches of a compact pattern in one text; pattern is always 0."""

    def eval(self, text: str, pattern: str):
        yield from page_matches(text, [parse_pattern(pattern)])


@udtf(returnType="variable string, page_no int, value string")
class TextFields:
    """The extracted contents of a compact pattern over the pages of one document, given as an array of (page_no, text)."""

    def eval(self, pages: list, pattern: str):
        p = parse_pattern(pattern)
        low, high = p.pages.bounds(len(pages or [])) if p.pages else (1, 1)
        found = [(page["page_no"], m[4]) for page in pages or [] if low <= page["page_no"] <= high for m in page_matches(page["text"], [p])]
        first, last = p.matches.bounds(len(found)) if p.matches else (1, 1)
        for page_no, value in found[first - 1 : last]:
            yield p.variable, page_no, value


def register(spark: SparkSession, **relations: DataFrame) -> None:
    """Registers the table functions, and each relation as a view of its name."""
    spark.udtf.register("keyword_matches", KeywordMatches)
    spark.udtf.register("text_fields", TextFields)
    spark.udtf.register("page_select", PageSelect)
    spark.udtf.register("text_values", TextValues)
    for name, df in relations.items():
        df.createOrReplaceTempView(name)
