"""Selections of any number of arguments: the arguments are a table, and pages meet them by joins.

Positions (numbers, ranges, steps, first and last) are spans on the page number, or on its distance from the end. A span of a
length up to 2^k covers two bins of width 2^k at most, so each is one or two rows of the table; a page is in one bin of
each width that occurs, at most 32. Equal bins meet and the span decides. Texts to be contained are one automaton
(``functions.keywords``), read in one pass, and joined by the number of the leaf. What is left (other patterns, booleans) is compiled as columns, each leaf once.
So the plan has the same size for ten arguments and for ten thousand."""

from __future__ import annotations

from dataclasses import replace
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequery.errors import SelectionError
from pagequery.functions.keywords import Automaton

from .ast import All, Argument, First, Last, Match, Section, Selection, Span, Step
from .compile import GROUP_COLUMNS, Plan, bounds, select
from .windows import ByDocument, ByRange

OPEN = (1 << 31) - 1  # the end of a span that has none
BROADCAST_ROWS = 1_000_000  # of arguments' bins, some 100 bytes each
SPANS = "arg int, low long, high long, step int, from_end boolean, reverse boolean, spec string, is_range boolean, needed long, level int, bin long"


def span_of(argument: Argument) -> tuple[int, int, int, bool, bool] | None:
    """low, high, step, whether counted from the end, whether reversed; None: no position."""
    node = argument.node
    if isinstance(node, All):
        return (1, OPEN, 1, False, False)
    if isinstance(node, Span):
        low, high = (node.stop, node.start) if node.reverse else (node.start, node.stop)
        return (1 if low is None else low, OPEN if high is None else high, 1, False, node.reverse)
    if isinstance(node, Step):
        return (node.start, OPEN if node.stop is None else node.stop, node.step, False, False)
    if isinstance(node, (First, Last)):
        return (1, node.count, 1, isinstance(node, Last), False)
    return None


def needed(argument: Argument) -> int:
    """The pages that a document must have for a position to be valid; more than any has if none will do."""
    found = bounds(argument.node) if argument.form in ("numeric", "page") else []
    return 0 if not found else max(found) if min(found) >= 1 else OPEN


def bins_of(low: int, high: int) -> tuple[int, range]:
    """The width (as a power of two) and the numbers of the one or two bins that a span covers."""
    level = min(31, max(0, (high - low).bit_length()))
    return level, range(low >> level, (high >> level) + 1)


@lru_cache(maxsize=8)
def automaton_of(values: tuple[str, ...]) -> Automaton:
    return Automaton(values)


def contained(pages: DataFrame, leaves: list[Match]) -> DataFrame:
    """doc_id, page_no, leaf: which of the texts each page contains, in one pass over the pages."""
    sides = [[(k, m.value.lower() if m.ignore_case else m.value) for k, m in enumerate(leaves) if m.ignore_case == fold] for fold in (False, True)]
    shared = pages.sparkSession.sparkContext.broadcast(sides)

    def run(batches):
        ready = [([k for k, _ in side], automaton_of(tuple(v for _, v in side)), fold) for side, fold in zip(shared.value, (False, True), strict=True) if side]
        for batch in batches:
            at, out = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for numbers, automaton, fold in ready if text else ():
                    found = automaton.found(text.lower() if fold else text)
                    at += [i] * len(found)
                    out += [numbers[x] for x in found]
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("page_no").take(at), pa.array(out, pa.int32())], ["doc_id", "page_no", "leaf"])

    kind = pages.schema["doc_id"].dataType.simpleString()
    return pages.select("doc_id", "page_no", "text").mapInArrow(run, f"doc_id {kind}, page_no int, leaf int")


def sized(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


class Arguments:
    """The arguments of a selection by the way that answers them."""

    def __init__(self, selection: Selection):
        self.selection = selection
        self.spans, self.texts, self.rest = [], [], []
        for k, a in enumerate(selection.arguments, 1):
            if isinstance(a.node, Section):
                raise SelectionError("sections have a number of groups of their own, so they are not taken in a table of arguments")
            if (span := span_of(a)) is not None:
                self.spans.append((k, a, span))
            elif isinstance(a.node, Match) and a.node.kind == "contains" and a.node.value:
                self.texts.append((k, a))
            else:
                self.rest.append((k, a))
        self.most = max((needed(a) for _, a, _ in self.spans), default=0)

    def table(self, spark, of_end: bool | None = None) -> tuple[DataFrame, list, int]:
        """The spans as a table, a row for each bin, the (from_end, level) pairs that occur, and the number of rows."""
        rows = []
        for k, a, (low, high, step, from_end, reverse) in self.spans:
            level, bins = bins_of(low, high)
            rows += [(k, low, high, step, from_end, reverse, a.spec, bool(a.is_range), needed(a), level, b) for b in bins]
        return spark.createDataFrame(rows, SPANS), sorted({(r[4], r[9]) for r in rows}), len(rows)


def select_table(pages: DataFrame, selection: Selection, on_error: str = "skip", each: int | None = None) -> DataFrame:
    """The selection relation of ``compile.select``, whatever the number of arguments. Sections are refused."""
    if on_error not in ("skip", "ignore", "raise"):
        raise SelectionError(f"unknown on_error: {on_error}")
    spark, arguments, out = pages.sparkSession, Arguments(selection), []
    from_end = any(span[3] for _, _, span in arguments.spans)
    lone = pages.select("doc_id", "page_no")
    windows = (ByRange(lone, each) if each else ByDocument(lone)) if from_end or arguments.most else None
    if windows:
        windows.highest("__n", F.col("page_no"))
        lone = windows.df
    valid = None
    if arguments.most and on_error != "ignore":
        if on_error == "raise" and (first := lone.where(F.col("__n") < arguments.most).select("doc_id").first()):
            raise SelectionError(f"the expression is invalid in document {first[0]}")
        lone = lone.where(F.col("__n") >= arguments.most)
        valid = lone.where("page_no = 1").select(F.col("doc_id").alias("__valid"))
    if arguments.spans:
        table, widths, n = arguments.table(spark)
        place = {False: F.col("page_no").cast("long"), True: (F.col("__n") - F.col("page_no") + 1).cast("long") if from_end else None}
        bins = F.array(*(F.struct(F.lit(end).alias("from_end"), F.lit(level).alias("level"), F.shiftright(place[end], level).alias("bin"), place[end].alias("place")) for end, level in widths))
        placed = lone.select("doc_id", "page_no", *(["__n"] if windows else []), F.explode(bins).alias("b")).select("*", "b.*").drop("b")
        met = placed.join(sized(table, n), ["from_end", "level", "bin"])
        met = met.where(F.col("place").between(F.col("low"), F.col("high")) & ((F.col("place") - F.col("low")) % F.col("step") == 0))
        if on_error == "ignore" and windows:
            met = met.where(F.col("__n") >= F.col("needed"))
        pos = F.when(F.col("reverse"), -F.col("page_no")).otherwise(F.col("page_no"))
        out.append(met.select("doc_id", F.col("arg").alias("group_ix"), pos.cast("int").alias("pos"), F.col("page_no").cast("int").alias("page_no"), "spec", "is_range"))

    def still_valid(df: DataFrame) -> DataFrame:
        return df if valid is None else df.join(valid, F.col("doc_id") == F.col("__valid"), "left_semi")

    if arguments.texts:
        leaves = list(dict.fromkeys(a.node for _, a in arguments.texts))
        number = {m: i for i, m in enumerate(leaves)}
        table = spark.createDataFrame([(k, number[a.node], a.spec) for k, a in arguments.texts], "group_ix int, leaf int, spec string")
        met = still_valid(contained(pages, leaves)).join(sized(table, len(arguments.texts)), "leaf")
        of_group = Window.partitionBy("doc_id", "group_ix")
        out.append(met.select("doc_id", "group_ix", F.col("page_no").cast("int").alias("pos"), F.col("page_no").cast("int").alias("page_no"), "spec", (F.count(F.lit(1)).over(of_group) > 1).alias("is_range")))
    if arguments.rest:
        numbers = F.array(*(F.lit(k) for k, _ in arguments.rest))
        some = select(pages, replace(selection, arguments=tuple(a for _, a in arguments.rest)), on_error, each)
        out.append(still_valid(some).withColumn("group_ix", F.element_at(numbers, F.col("group_ix"))).select("doc_id", "group_ix", "pos", "page_no", "spec", "is_range"))
    rows = reduce(DataFrame.unionByName, out)
    return rows.withColumn("preserve_order", F.lit(selection.preserve_order)).select(*GROUP_COLUMNS)


# --- what is wrong with an expression, document by document -----------------------------------------------------------

PROBLEMS = ("doc_id", "argument", "spec", "reason")


def problems(pages: DataFrame, selection: Selection, each: int | None = None) -> DataFrame:
    """doc_id, argument (from 1), spec, reason: a row for each document and argument that is invalid in it.

    Documents meet the positions that they are too short for by bins of their number of pages, as pages meet spans."""
    spark, out = pages.sparkSession, []
    positions = [(k, a, needed(a)) for k, a in enumerate(selection.arguments, 1) if not isinstance(a.node, Section) and needed(a)]
    if positions:
        rows = [(k, a.spec, n, level, b) for k, a, n in positions for level, bins in [bins_of(0, n - 1)] for b in bins]
        table = spark.createDataFrame(rows, "argument int, spec string, needed long, level int, bin long")
        lengths = pages.groupBy("doc_id").agg(F.max("page_no").cast("long").alias("__n"))
        bins = F.array(*(F.struct(F.lit(level).alias("level"), F.shiftright(F.col("__n"), level).alias("bin")) for level in sorted({r[3] for r in rows})))
        met = lengths.select("doc_id", "__n", F.explode(bins).alias("b")).select("doc_id", "__n", "b.*").join(sized(table, len(rows)), ["level", "bin"]).where(F.col("__n") < F.col("needed"))
        none = F.lit("page numbers begin at 1")
        beyond = F.concat(F.lit("page "), F.col("needed").cast("string"), F.lit(" of "), F.col("__n").cast("string"))
        out.append(met.select("doc_id", "argument", "spec", F.when(F.col("needed") == OPEN, none).otherwise(beyond).alias("reason")))
    sections = [(k, a) for k, a in enumerate(selection.arguments, 1) if isinstance(a.node, Section)]
    if sections:
        plan = Plan(pages, [a.node for _, a in sections], each=each)
        ends = [plan.section_end(a.node) for _, a in sections]
        starts = [plan.column(a.node.start) for _, a in sections]
        counted = plan.df.groupBy("doc_id").agg(*(F.count(e).alias(f"__e{i}") for i, e in enumerate(ends)), *(F.count_if(s).alias(f"__s{i}") for i, s in enumerate(starts)))
        found: list[Column] = []
        for i, (k, a) in enumerate(sections):
            why = F.when(F.col(f"__s{i}") == 0, "no start").otherwise("no end behind a start")
            found.append(F.when(F.col(f"__e{i}") == 0, F.struct(F.lit(k).alias("argument"), F.lit(a.spec).alias("spec"), why.alias("reason"))))
        out.append(counted.select("doc_id", F.explode(F.array_compact(F.array(*found))).alias("p")).select("doc_id", "p.*"))
    if not out:
        return pages.select("doc_id", F.lit(0).alias("argument"), F.lit("").alias("spec"), F.lit("").alias("reason")).where(F.lit(False))
    return reduce(DataFrame.unionByName, out).select(*PROBLEMS)
