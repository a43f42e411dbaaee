"""Page sets that are kept: an expression that was answered before, in whatever order it is written, is read and not computed.

A set is kept under the canonical form of its tree (operands of & and | in one order and once each, double negations gone) and a
snapshot of its input: the files of the pages with their sizes and times, and how pages are made of them. So a change of the
files is another snapshot, and what was kept for the old one is not read again.

What is not kept is computed from kept leaves. A pattern's flags are computed once, all that an expression lacks in one pass over the texts, and stored
as a column of booleans by page, which Parquet packs to bits. Any expression over patterns that were seen before scans
these columns alone, never a text."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequery.errors import SelectionError
from pagequery.sources.sinks import path_exists
from pagequery.storage import shared_folder

from .ast import And, Match, Node, Not, Or, Section, Shift
from .compile import Plan, predicate, walk
from .parser import parse_argument


def canonical(node: Node) -> Node:
    """The form that equal expressions share."""
    if isinstance(node, Not):
        inside = canonical(node.node)
        return inside.node if isinstance(inside, Not) else Not(inside)
    if isinstance(node, (And, Or)):
        kind, parts, waiting = type(node), [], [node.left, node.right]
        while waiting:
            x = canonical(waiting.pop())
            if isinstance(x, kind):
                waiting += [x.left, x.right]
            else:
                parts.append(x)
        ordered = sorted(set(parts), key=repr)
        return reduce(kind, ordered)
    if isinstance(node, Shift):
        return Shift(canonical(node.node), node.by)
    if isinstance(node, Section):
        return Section(canonical(node.start), canonical(node.end))
    return node


def name_of(*parts: object) -> str:
    return hashlib.sha256("\0".join(map(repr, parts)).encode()).hexdigest()[:32]


def snapshot(pages: DataFrame) -> str:
    """What a page relation reads: its plan, and its files as they are now."""
    spark = pages.sparkSession
    files = sorted(pages.inputFiles())
    if not files:
        raise SelectionError("only page sets of files can be kept")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf, seen = spark.sparkContext._jsc.hadoopConfiguration(), []
    for folder in sorted({f.rsplit("/", 1)[0] for f in files}):
        at = hadoop.Path(spark.sparkContext._jvm.java.net.URI(folder))
        wanted = {f for f in files if f.rsplit("/", 1)[0] == folder}
        for status in at.getFileSystem(conf).listStatus(at):
            if status.getPath().toUri().toString() in wanted or status.getPath().toString() in wanted:
                seen.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return name_of(pages._jdf.queryExecution().analyzed().canonicalized().toString(), sorted(seen) or files)


class Stored(Plan):
    """A plan over flags that are stored."""

    def __init__(self, flags: DataFrame, matches: list[Match], columns: dict[Match, str], each: int | None):
        from .windows import ByDocument, ByRange

        self.columns = {m: F.col(columns[m]) for m in matches}
        kept = flags.select("doc_id", "page_no", *(columns[m] for m in matches))
        self.windows = ByRange(kept, each) if each else ByDocument(kept)
        self.made = 0


class PageSets:
    """Kept page sets of a page relation, in a folder that driver and executors share (a folder of the session's application, unless named)."""

    def __init__(self, pages: DataFrame, folder: str | None = None, range_pages: int | None = None):
        spark = pages.sparkSession
        self.pages, self.spark, self.each = pages, spark, range_pages
        self.folder = folder or f"{shared_folder(spark)}/pagequery-{spark.sparkContext.applicationId}/kept"

    def at(self, *parts: object) -> str:
        """The path of what is kept by this name for the input as it is now."""
        return f"{self.folder}/{snapshot(self.pages)}/{name_of(*parts)}"

    def is_kept(self, path: str) -> bool:
        return path_exists(self.spark, f"{path}/_SUCCESS")

    def column(self, leaf: Match) -> str:
        return f"f{name_of(leaf)}"

    def flags(self, leaves: list[Match]) -> DataFrame:
        """doc_id, page_no and a column for each leaf; those that are not kept are computed together."""
        paths = {m: self.at("leaf", m) for m in leaves}
        lacking = [m for m in leaves if not self.is_kept(paths[m])]
        if lacking:
            whole = self.at("flags", sorted(map(repr, lacking)))
            if not self.is_kept(whole):
                self.pages.select("doc_id", "page_no", *(predicate(m).alias(self.column(m)) for m in lacking)).write.mode("overwrite").parquet(whole)
            for m in lacking:  # a leaf's path names the table that holds its column
                self.spark.createDataFrame([(whole,)], "path string").coalesce(1).write.mode("overwrite").parquet(paths[m])
        tables: dict[str, list[Match]] = {}
        for m in leaves:
            tables.setdefault(self.spark.read.parquet(paths[m]).first()[0], []).append(m)
        found = [self.spark.read.parquet(path).select("doc_id", "page_no", *map(self.column, of)) for path, of in tables.items()]
        return reduce(lambda a, b: a.join(b, ["doc_id", "page_no"]), found)

    def where(self, expression: str) -> DataFrame:
        """doc_id, page_no of the pages of one argument, kept from now on."""
        node = canonical(parse_argument(expression).node)
        path = self.at("set", node)
        if not self.is_kept(path):
            leaves = list(dict.fromkeys(x for x in walk(node) if isinstance(x, Match)))
            flags = self.flags(leaves) if leaves else self.pages.select("doc_id", "page_no")
            plan = Stored(flags, leaves, {m: self.column(m) for m in leaves}, self.each)
            member = plan.column(node)
            plan.df.where(member).select("doc_id", "page_no").write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)
