"""Selections on streams of pages where whole documents are needed: offsets, sections, last pages, boundaries, duplicates.

Pages come in any order and in any batch. Patterns are evaluated as columns when a page comes; what is kept of it in the state is a
flag for each, never its text. A document's state is a map from page numbers to flags, so a batch touches only the pages it brings. A document is
closed as soon as it is complete, where the stream tells how many pages it has, and otherwise when the watermark passes its last
page by ``wait``, by a timer on event time. Then its rows are emitted, which are those of the batch selection, and its pages go. A closed
document is remembered until the watermark passes, so that a page that comes twice gives nothing; later pages are dropped."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagequery.plans.compile import GROUP_COLUMNS, predicate
from pagequery.plans.evaluate import Document, first_listings, leaves
from pagequery.plans.parser import parse, parse_pattern

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RESULT = Row("doc_id", "group_ix", "pos", "page_no", "spec", "is_range", "preserve_order")


def milliseconds(of: datetime) -> int:
    return int(of.timestamp() * 1000)


class Selecting(StatefulProcessor):
    """State by document: its pages' flags, its last event time, and whether it is closed."""

    def __init__(self, expression: str, start: str | None, end: str | None, dedup: bool, wait_ms: int):
        self.expression, self.ends, self.dedup, self.wait_ms = expression, (start, end), dedup, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.selection = parse(self.expression)
        self.split_by = [parse_pattern(x) if x else None for x in self.ends]
        self.leaves = leaves([*(a.node for a in self.selection.arguments), *filter(None, self.split_by)])
        self.pages = handle.getMapState("pages", "page_no int", "flags string")
        self.facts = handle.getValueState("facts", "pages int, last long, closed boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        seen, last, closed = self.facts.get() if self.facts.exists() else (0, None, False)
        before, total = last, None
        for row in rows:
            at = milliseconds(row["event_time"])
            if at < watermark:
                continue
            last = at if last is None else max(last, at)
            if closed:
                continue
            total = row["n_pages"] if row["n_pages"] is not None else total
            page = (row["page_no"],)
            seen += not self.pages.containsKey(page)
            self.pages.updateValue(page, (row["flags"],))
        if last is None:  # all rows were late
            return
        if last != before:
            if before is not None:
                self.handle.deleteTimer(before + self.wait_ms)
            self.handle.registerTimer(last + self.wait_ms)
        if not closed and total is not None and seen >= total:
            yield from self.selected(key)
            self.pages.clear()
            closed = True
        self.facts.update((seen, last, closed))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        closed = self.facts.get()[2] if self.facts.exists() else True
        if not closed:
            yield from self.selected(key)
        self.pages.clear()
        self.facts.clear()

    def selected(self, key) -> Iterator[Row]:
        document = Document({page: [c == "1" for c in flags] for (page,), (flags,) in self.pages.iterator()}, self.leaves)
        rows = document.rows(self.selection)
        if any(self.split_by):
            rows = document.split(rows, *self.split_by)
        for row in first_listings(rows) if self.dedup else rows:
            yield RESULT(key[0], *row)

    def close(self) -> None:
        pass


def selection_stream(pages: DataFrame, expression: str, event_time: str = "event_time", wait: float = 600, n_pages: Column | None = None, group_start: str | None = None, group_end: str | None = None, dedup: bool = False) -> DataFrame:
    """The selection relation of a stream of pages, by document: documents that an argument is invalid in are left out.

    event_time: the column of a page's time, with a watermark; wait: the seconds without a page, by the watermark, after which a document is closed;
    n_pages: how many pages the document has, if known. A page that comes again replaces the one before. Needs the RocksDB state store, which is set for the session."""
    spark = pages.sparkSession
    spark.conf.set(PROVIDER, ROCKSDB)
    selection = parse(expression)
    found = leaves([*(a.node for a in selection.arguments), *(parse_pattern(x) for x in (group_start, group_end) if x)])
    flags = F.concat(F.lit(""), *(F.when(predicate(m), "1").otherwise("0") for m in found))
    total = F.lit(None) if n_pages is None else n_pages
    rows = pages.select("doc_id", F.col("page_no").cast("int").alias("page_no"), F.col(event_time).alias("event_time"), total.cast("int").alias("n_pages"), flags.alias("flags"))
    kind = pages.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, group_ix int, pos int, page_no int, spec string, is_range boolean, preserve_order boolean"
    made = rows.groupBy("doc_id").transformWithState(Selecting(expression, group_start, group_end, dedup, int(wait * 1000)), schema, "Append", "EventTime")
    return made.select(*GROUP_COLUMNS)
