"""What looks beyond a page, by two ways that give the same columns.

``ByDocument``: windows that partition by document. One exchange for any expression; a document is one task.

``ByRange``: a document is cut into ranges of pages, and every window partitions by (document, range). Each range is summarised (its
last page, its sum, its first and last mark), the summaries of a document are scanned in order, and the carry is handed down to the
range's pages by a join on the same key. So a document is as many tasks as it has ranges; only summaries, a row a range,
meet by document. Flags are stored once without the text, so what reads them twice reads a few bytes a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pagequery.storage import stored

FIRST, LAST, HERE = Window.unboundedPreceding, Window.unboundedFollowing, Window.currentRow


class ByDocument:
    """Adds columns to a relation (doc_id, page_no, ...) by windows over whole documents."""

    def __init__(self, df: DataFrame):
        self.df = df

    @property
    def whole(self) -> WindowSpec:
        return Window.partitionBy("doc_id")

    @property
    def ordered(self) -> WindowSpec:
        return self.whole.orderBy("page_no")

    def add(self, name: str, value: Column) -> None:
        """A column that looks at its page alone."""
        self.df = self.df.withColumn(name, value)

    def highest(self, name: str, value: Column) -> None:
        """The largest value of the document."""
        self.add(name, F.max(value).over(self.whole))

    def total(self, name: str, value: Column) -> None:
        """The sum of the document's values."""
        self.add(name, F.coalesce(F.sum(value).over(self.whole), F.lit(0)))

    def running(self, name: str, value: Column) -> None:
        """The sum of the values up to this page."""
        self.add(name, F.coalesce(F.sum(value).over(self.ordered.rowsBetween(FIRST, HERE)), F.lit(0)))

    def latest(self, name: str, value: Column) -> None:
        """The last value that is not null, up to this page."""
        self.add(name, F.last(value, ignorenulls=True).over(self.ordered.rowsBetween(FIRST, HERE)))

    def least_ahead(self, name: str, value: Column) -> None:
        """The least value from this page on."""
        self.add(name, F.min(value).over(self.ordered.rowsBetween(HERE, LAST)))

    def shifted(self, name: str, flag: Column, by: int) -> None:
        """The flag of the page that lies by pages before."""
        moved = F.lag(flag, by).over(self.ordered) if by > 0 else F.lead(flag, -by).over(self.ordered)
        self.add(name, F.coalesce(moved, F.lit(False)))


class ByRange(ByDocument):
    """The same by ranges of so many pages. Scans of one range run in one task, scans of a document's summaries in another."""

    RANGE = "__range"

    def __init__(self, df: DataFrame, each: int):
        if each < 1:
            raise ValueError(f"a range has at least one page, not {each}")
        self.each = each
        self.df = stored(df.withColumn(self.RANGE, self.range_of(F.col("page_no"))), "flags")

    def range_of(self, page: Column) -> Column:
        return F.floor((page - 1) / self.each).cast("int")

    @property
    def whole(self) -> WindowSpec:
        return Window.partitionBy("doc_id", self.RANGE)

    def carried(self, name: str, summary: Column, scan) -> None:
        """Adds a column: what scan makes, over the ranges of the document in their order, of the summary of each."""
        of_range = self.df.groupBy("doc_id", self.RANGE).agg(summary.alias("__of"))
        over = Window.partitionBy("doc_id").orderBy(self.RANGE)
        scanned = of_range.select(F.col("doc_id").alias("__doc"), F.col(self.RANGE).alias("__in"), scan(F.col("__of"), over).alias(name))
        self.df = self.df.join(scanned, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col(self.RANGE) == F.col("__in"))).drop("__doc", "__in")

    def highest(self, name: str, value: Column) -> None:
        self.carried(name, F.max(value), lambda x, over: F.max(x).over(over.rowsBetween(FIRST, LAST)))

    def total(self, name: str, value: Column) -> None:
        self.carried(name, F.sum(value), lambda x, over: F.coalesce(F.sum(x).over(over.rowsBetween(FIRST, LAST)), F.lit(0)))

    def running(self, name: str, value: Column) -> None:
        self.carried(f"{name}_before", F.sum(value), lambda x, over: F.sum(x).over(over.rowsBetween(FIRST, -1)))
        inside = F.sum(value).over(self.ordered.rowsBetween(FIRST, HERE))
        self.add(name, F.coalesce(inside, F.lit(0)) + F.coalesce(f"{name}_before", F.lit(0)))

    def latest(self, name: str, value: Column) -> None:
        last = F.max_by(F.struct(value.alias("v")), F.when(value.isNotNull(), F.col("page_no")))["v"]
        self.carried(f"{name}_before", last, lambda x, over: F.last(x, ignorenulls=True).over(over.rowsBetween(FIRST, -1)))
        inside = F.last(value, ignorenulls=True).over(self.ordered.rowsBetween(FIRST, HERE))
        self.add(name, F.coalesce(inside, F.col(f"{name}_before")))

    def least_ahead(self, name: str, value: Column) -> None:
        self.carried(f"{name}_behind", F.min(value), lambda x, over: F.min(x).over(over.rowsBetween(1, LAST)))
        inside = F.min(value).over(self.ordered.rowsBetween(HERE, LAST))
        self.add(name, F.least(inside, F.col(f"{name}_behind")))

    def shifted(self, name: str, flag: Column, by: int) -> None:
        """Flagged pages whose target lies in another range are sent there; within a range the distance in pages finds them."""
        marked = self.df.withColumn(name, flag).withColumn("__sent", F.lit(False))
        target = self.range_of(F.col("page_no") + by)
        sent = marked.where(F.col(name) & (target != F.col(self.RANGE))).withColumn(self.RANGE, target).withColumn("__sent", F.lit(True))
        both = marked.unionByName(sent)
        there = F.max(F.when(F.col(name), True)).over(self.ordered.rangeBetween(-by, -by))
        self.df = both.withColumn("__there", there).where(~F.col("__sent")).withColumn(name, F.coalesce("__there", F.lit(False))).drop("__there", "__sent")
