"""Operators on the selection relation: boundaries, group filters, duplicates, order and descriptions."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pagequery.errors import SelectionError
from pagequery.plans.ast import Node
from pagequery.plans.compile import GROUP_COLUMNS, Plan, page_set
from pagequery.plans.windows import FIRST, HERE, LAST
from pagequery.plans.parser import is_index_filter, parse_criteria, parse_indices, parse_pattern, validate_filter
from pagequery.storage import stored


def group() -> WindowSpec:
    return Window.partitionBy("doc_id", "group_ix")


def nested(selection: DataFrame) -> DataFrame:
    """One row a group: its pages in order, spec and flags."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "page_no"))), lambda x: x["page_no"])
    return selection.groupBy("doc_id", "group_ix").agg(ordered.alias("pages"), F.first("spec").alias("spec"), F.first("is_range").alias("is_range"), F.first("preserve_order").alias("preserve_order"))


def flattened(groups: DataFrame) -> DataFrame:
    """The selection relation of nested groups; pos counts from 0."""
    return groups.select("doc_id", "group_ix", F.posexplode("pages").alias("pos", "page_no"), "spec", "is_range", "preserve_order").select(*GROUP_COLUMNS)


def consecutive(pages: Column) -> Column:
    """Whether each page follows the one before, or each precedes it."""
    steps = F.zip_with(F.slice(pages, 2, F.greatest(F.size(pages) - 1, F.lit(0))), F.slice(pages, 1, F.greatest(F.size(pages) - 1, F.lit(0))), lambda b, a: b - a)
    return (F.size(pages) > 1) & (F.forall(steps, lambda d: d == 1) | F.forall(steps, lambda d: d == -1))


def ordered_group(pages: Column, spec: Column, preserve: Column | bool = False) -> Column:
    """pages, is_range of a group made from a list: duplicates go and pages ascend, unless it preserves its order or reads as a range."""
    preserve = F.lit(preserve) if isinstance(preserve, bool) else preserve
    keeps = preserve | spec.rlike(r"^\s*\d+\s*(?:-|:|\.\.)\s*\d+\s*$")
    out = F.when(keeps, pages).otherwise(F.array_sort(F.array_distinct(pages)))
    return F.struct(out.alias("pages"), consecutive(out).alias("is_range"))


def range_group(start: Column, stop: Column) -> Column:
    """The pages between two ends, whichever is first."""
    return F.sequence(F.least(start, stop), F.greatest(start, stop))


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """One selection of two, in order: the second's groups follow the first's in each document, numbered on; documents of either are kept."""
    of = first.groupBy(F.col("doc_id").alias("__doc")).agg(F.max("group_ix").alias("__groups"))
    behind = second.join(of, F.col("doc_id").eqNullSafe(F.col("__doc")), "left").withColumn("group_ix", (F.col("group_ix") + F.coalesce("__groups", F.lit(0))).cast("int"))
    return first.select(*GROUP_COLUMNS).unionByName(behind.select(*GROUP_COLUMNS))


def renumbered(df: DataFrame, *order: str) -> DataFrame:
    return df.withColumn("group_ix", F.dense_rank().over(Window.partitionBy("doc_id").orderBy(*order)))


def split_at(selection: DataFrame, pages: DataFrame, start: str | None = None, end: str | None = None, each: int | None = None) -> DataFrame:
    """Groups split where a page matches the pattern start (it opens a group) or end (it closes one, inclusively).

    Pages of a group are taken in ascending order, groups are numbered anew and named by their pages. each: by ranges of so many pages, in two levels."""
    if not start and not end:
        return selection
    nodes = [parse_pattern(p) if p else None for p in (start, end)]
    plan = Plan(pages, [n for n in nodes if n], each=each)
    flags = [plan.column(n) if n else F.lit(False) for n in nodes]
    marks = plan.df.select("doc_id", "page_no", flags[0].alias("__opens"), flags[1].alias("__closes"))
    if each:
        return _split_by_range(selection, marks, each)
    in_group = Window.partitionBy("doc_id", "group_ix").orderBy("page_no", "pos")
    df = selection.join(marks, ["doc_id", "page_no"]).repartition("doc_id")  # one exchange serves the windows of groups and of documents
    opens = F.when((F.row_number().over(in_group) == 1) | F.col("__opens") | F.coalesce(F.lag("__closes").over(in_group), F.lit(False)), 1).otherwise(0)
    df = df.withColumn("__new", opens).withColumn("__part", F.sum("__new").over(in_group.rowsBetween(Window.unboundedPreceding, 0)))
    df = renumbered(df, "group_ix", "__part")
    low, high, n = F.min("page_no").over(group()), F.max("page_no").over(group()), F.count("page_no").over(group())
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("page_no").over(group())), lambda x: x.cast("string")), ",")
    spec = F.when(n == 1, F.concat(F.lit("page"), low.cast("string"))).when(high - low + 1 == n, F.concat(F.lit("pages"), low.cast("string"), F.lit("-"), high.cast("string"))).otherwise(F.concat(F.lit("pages"), listed))
    out = df.withColumns({"__spec": spec, "__n": n})
    return out.select("doc_id", "group_ix", F.col("page_no").alias("pos"), "page_no", F.col("__spec").alias("spec"), (F.col("__n") > 1).alias("is_range"), F.lit(False).alias("preserve_order"))


def _handed_down(df: DataFrame, summary: dict[str, Column], scans: dict[str, Column], key: list[str]) -> DataFrame:
    """df with the scans of its summaries, which are a row for each key."""
    scanned = df.groupBy(*key).agg(*(v.alias(k) for k, v in summary.items())).select(*(F.col(k).alias(f"__{k}") for k in key), *(v.alias(k) for k, v in scans.items()))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]
    return df.join(scanned, same).drop(*(f"__{k}" for k in key))


def _split_by_range(selection: DataFrame, marks: DataFrame, each: int) -> DataFrame:
    """The same in two levels: whether the page before a range closes, how many groups open before it, and the extent of each
    group come from the ranges' summaries, a row for each range of each group."""
    key = ["doc_id", "group_ix", "range"]
    df = selection.join(marks, ["doc_id", "page_no"]).withColumn("range", F.floor((F.col("page_no") - 1) / each).cast("int"))
    df = stored(df.select(*key, "page_no", "pos", "__opens", "__closes"), "split")
    inside = Window.partitionBy(*key).orderBy("page_no", "pos")
    of_group = Window.partitionBy("doc_id", "group_ix").orderBy("range")
    # whether the page before closes its group; null on the group's first page
    df = _handed_down(df, {"__last": F.max_by("__closes", F.struct("page_no", "pos"))}, {"__before": F.lag("__last").over(of_group)}, key)
    before = F.coalesce(F.lag("__closes").over(inside), F.col("__before"))
    df = df.withColumn("__new", (before.isNull() | F.col("__opens") | F.coalesce(before, F.lit(False))).cast("int"))
    df = stored(df.select(*key, "page_no", "pos", "__new"), "opened")
    in_order = Window.partitionBy("doc_id").orderBy("group_ix", "range").rowsBetween(FIRST, -1)
    df = _handed_down(df, {"__sum": F.sum("__new")}, {"__start": F.coalesce(F.sum("__sum").over(in_order), F.lit(0))}, key)
    number = F.sum("__new").over(inside.rowsBetween(FIRST, HERE)) + F.col("__start")
    df = stored(df.select("doc_id", number.cast("int").alias("group_ix"), "range", "page_no"), "numbered")
    whole = Window.partitionBy("doc_id", "group_ix").orderBy("range").rowsBetween(FIRST, LAST)
    facts = {"low": F.min("page_no"), "high": F.max("page_no"), "n": F.count(F.lit(1))}
    scans = {"__low": F.min("low").over(whole), "__high": F.max("high").over(whole), "__n": F.sum("n").over(whole)}
    df = _handed_down(df, facts, scans, key)
    low, high, n, even = F.col("__low"), F.col("__high"), F.col("__n"), F.col("__high") - F.col("__low") + 1 == F.col("__n")
    # only groups with gaps are named by all their pages, which is as long as they are
    gapped = df.where(~even).groupBy(F.col("doc_id").alias("__doc"), F.col("group_ix").alias("__group")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("page_no")), lambda x: x.cast("string")), ",").alias("__listed"))
    df = df.join(gapped, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("group_ix") == F.col("__group")) & ~even, "left")
    spec = F.when(n == 1, F.concat(F.lit("page"), low.cast("string"))).when(even, F.concat(F.lit("pages"), low.cast("string"), F.lit("-"), high.cast("string"))).otherwise(F.concat(F.lit("pages"), F.col("__listed")))
    return df.select("doc_id", "group_ix", F.col("page_no").alias("pos"), "page_no", spec.alias("spec"), (n > 1).alias("is_range"), F.lit(False).alias("preserve_order"))


def kept_flag(selection: DataFrame, pages: DataFrame, criteria: str, each: int | None = None) -> DataFrame:
    """The selection with the column kept: whether the group satisfies the criteria (group numbers, or a content filter that any of its pages is in)."""
    ok, why = validate_filter(criteria)
    if not ok:
        raise SelectionError(why)
    if is_index_filter(criteria):
        spans = parse_indices(criteria)
        kept = F.lit(False)
        for a, b in spans:
            kept = kept | F.col("group_ix").between(a, b)
        return selection.withColumn("kept", kept)
    try:
        node = parse_criteria(criteria)
    except SelectionError as e:
        warnings.warn(f"{e}: no group is kept", stacklevel=2)
        return selection.withColumn("kept", F.lit(False))
    found = page_set(pages, node, each=each).withColumn("__in", F.lit(True))
    if each:  # the groups with such a page, and their rows: no group is gathered
        hit = selection.join(found, ["doc_id", "page_no"]).groupBy(F.col("doc_id").alias("__doc"), F.col("group_ix").alias("__group")).agg(F.max("__in").alias("__in"))
        joined = selection.join(hit, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("group_ix") == F.col("__group")), "left")
        return joined.withColumn("kept", F.coalesce("__in", F.lit(False))).drop("__in", "__doc", "__group")
    return selection.join(found, ["doc_id", "page_no"], "left").withColumn("kept", F.coalesce(F.max("__in").over(group()), F.lit(False))).drop("__in")


def keep_groups(selection: DataFrame, pages: DataFrame, criteria: str | None, each: int | None = None) -> DataFrame:
    """Only the groups that satisfy the criteria; numbers stay. No criteria: all."""
    if not (criteria or "").strip():
        return selection
    return kept_flag(selection, pages, criteria, each).where("kept").select(*GROUP_COLUMNS)


def preview_filter(selection: DataFrame, pages: DataFrame, criteria: str) -> DataFrame:
    """doc_id, group_ix, spec, n_pages, status: KEEP or SKIP."""
    df = kept_flag(selection, pages, criteria)
    return df.groupBy("doc_id", "group_ix").agg(F.first("spec").alias("spec"), F.count("page_no").alias("n_pages"), F.when(F.max("kept"), "KEEP").otherwise("SKIP").alias("status"))


def describe_filter(before: DataFrame, after: DataFrame) -> str:
    """How many groups a filter kept (two small counts)."""
    a, b = (x.select("doc_id", "group_ix").distinct().count() for x in (before, after))
    return f"{b} of {a} groups kept"


def overlaps(pages: Column, target: Column) -> Column:
    return F.arrays_overlap(pages, target)


def contains_all(pages: Column, target: Column) -> Column:
    return F.size(F.array_except(target, pages)) == 0


def group_sizes(selection: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, group_ix, size_bytes"""
    return selection.join(pages.select("doc_id", "page_no", "size_bytes"), ["doc_id", "page_no"]).groupBy("doc_id", "group_ix").agg(F.sum("size_bytes").alias("size_bytes"))


# --- duplicates -------------------------------------------------------------------------------------------------------


def duplicates(selection: DataFrame) -> DataFrame:
    """doc_id, page_no, n, groups: the pages that are listed more than once, also within a group."""
    groups = F.array_sort(F.collect_list(F.struct("group_ix", "spec")))
    return selection.groupBy("doc_id", "page_no").agg(F.count(F.lit(1)).alias("n"), groups.alias("groups")).where("n > 1")


def default_strategy(explicit: str | None = None, respect_groups: bool = False) -> str:
    return explicit or ("groups" if respect_groups else "strict")


def dedup(selection: DataFrame, strategy: str = "strict") -> DataFrame:
    """strict: the first listing of a page in its document stays; groups: the first in its group; none: all stay; warn: strict, with a
    warning; fail: an error if there are duplicates (the last two cost an action)."""
    if strategy == "none":
        return selection
    if strategy in ("warn", "fail"):
        n = duplicates(selection).count()
        if n and strategy == "fail":
            raise SelectionError(f"{n} pages are listed more than once")
        if n:
            warnings.warn(f"{n} pages are listed more than once; the first listing stays", stacklevel=2)
        strategy = "strict"
    if strategy not in ("strict", "groups"):
        raise SelectionError(f"unknown strategy: {strategy}")
    key = ("doc_id", "page_no") if strategy == "strict" else ("doc_id", "page_no", "group_ix")
    first = Window.partitionBy(*key).orderBy("group_ix", "pos")
    return selection.withColumn("__rn", F.row_number().over(first)).where("__rn = 1").drop("__rn")


# --- order and text ---------------------------------------------------------------------------------------------------


def with_order(selection: DataFrame) -> DataFrame:
    """pos is the page's number in groups that neither are ranges nor preserve their order."""
    return selection.withColumn("pos", F.when(F.col("is_range") | F.col("preserve_order"), F.col("pos")).otherwise(F.col("page_no")))


def ordered_pages(selection: DataFrame, strategy: str = "strict", each: int | None = None) -> DataFrame:
    """doc_id, out_ix, page_no: the pages of all groups in their order, out_ix from 1. each: by ranges of so many places of a group, in two levels."""
    df = with_order(dedup(selection, strategy))
    if each:
        key = ["doc_id", "group_ix", "range"]
        df = stored(df.select("doc_id", "group_ix", F.floor(F.col("pos") / each).cast("int").alias("range"), "pos", "page_no"), "ordered")
        in_order = Window.partitionBy("doc_id").orderBy("group_ix", "range").rowsBetween(FIRST, -1)
        df = _handed_down(df, {"__rows": F.count(F.lit(1))}, {"__start": F.coalesce(F.sum("__rows").over(in_order), F.lit(0))}, key)
        place = F.row_number().over(Window.partitionBy(*key).orderBy("pos", "page_no")) + F.col("__start")
        return df.select("doc_id", place.cast("int").alias("out_ix"), "page_no")
    return df.withColumn("out_ix", F.row_number().over(Window.partitionBy("doc_id").orderBy("group_ix", "pos", "page_no"))).select("doc_id", "out_ix", "page_no")


def runs_of_pages(pages: DataFrame, each: int | None = None) -> DataFrame:
    """doc_id, a, b: the runs of consecutive pages of the set pages(doc_id, page_no). each: by ranges of so many pages, whose border runs are joined by a scan of the ranges' summaries."""
    df = pages.select("doc_id", "page_no").distinct()
    if not each:
        islands = df.withColumn("__i", F.col("page_no") - F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no")))
        return islands.groupBy("doc_id", "__i").agg(F.min("page_no").alias("a"), F.max("page_no").alias("b")).drop("__i")
    key = ["doc_id", "range"]
    df = df.withColumn("range", F.floor((F.col("page_no") - 1) / each).cast("int"))
    islands = df.withColumn("__i", F.col("page_no") - F.row_number().over(Window.partitionBy(*key).orderBy("page_no")))
    pieces = stored(islands.groupBy(*key, "__i").agg(F.min("page_no").alias("a"), F.max("page_no").alias("b")).drop("__i"), "runs")
    # a piece that begins a range goes on from one that ends the range before: its run begins where the first of such pieces does
    starts = (F.col("a") - 1) % each == 0
    over = Window.partitionBy("doc_id").orderBy("range")
    joins = {"__first_goes_on": F.max(starts), "__last": F.max("b"), "__alone": (F.count(F.lit(1)) == 1) & F.max(starts)}
    of_range = pieces.groupBy(*key).agg(*(v.alias(k) for k, v in joins.items()), F.max_by("a", "b").alias("__last_a"))
    linked = F.col("__first_goes_on") & F.coalesce(F.lag("__last").over(over) == F.col("range") * each, F.lit(False))
    of_range = of_range.withColumn("__linked", linked)
    # where the run that is open at a range's end began: carried on through ranges that are one linked piece
    of_range = of_range.withColumn("__open", F.last(F.when(F.col("__linked") & F.col("__alone"), None).otherwise(F.col("__last_a")), ignorenulls=True).over(over.rowsBetween(FIRST, HERE)))
    of_range = of_range.withColumn("__began", F.when(F.col("__linked"), F.lag("__open").over(over))).select(F.col("doc_id").alias("__doc"), F.col("range").alias("__in"), "__began")
    joined = pieces.join(of_range, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("range") == F.col("__in")))
    begin = F.when(starts, F.coalesce("__began", F.col("a"))).otherwise(F.col("a"))
    return joined.groupBy("doc_id", begin.alias("a")).agg(F.max("b").alias("b"))


def format_ranges(pages: DataFrame, each: int | None = None) -> DataFrame:
    """doc_id, ranges: the set of pages(doc_id, page_no) as '1-3, 5'. The text of a document is one value, as long as it has runs."""
    runs = runs_of_pages(pages, each)
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    listed = F.array_sort(F.collect_list(F.struct("a", text.alias("t"))))
    return runs.groupBy("doc_id").agg(F.array_join(F.transform(listed, lambda x: x["t"]), ", ").alias("ranges"))


def unselected(pages: DataFrame, selection: DataFrame) -> DataFrame:
    """doc_id, page_no of the pages that are in no group."""
    return pages.select("doc_id", "page_no").join(selection.select("doc_id", "page_no"), ["doc_id", "page_no"], "left_anti")


def output_estimates(pages: DataFrame, selection: DataFrame) -> DataFrame:
    """doc_id, size_mb: the source's size times the share of its pages that are selected."""
    all_ = pages.groupBy("doc_id").agg(F.count("page_no").alias("n"), (F.sum("size_bytes") / 1048576).alias("mb"))
    some = selection.groupBy("doc_id").agg(F.countDistinct("page_no").alias("k"))
    return all_.join(some, "doc_id").select("doc_id", (F.col("mb") * F.col("k") / F.col("n")).alias("size_mb"))


def as_set(node: Node, pages: DataFrame) -> DataFrame:
    return page_set(pages, node)
