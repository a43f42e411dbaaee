"""Text from character boxes: chars(doc_id, page_no, text, x0, x1, y1).

Which characters make a line depends on the line's first character: a fold over a page's distinct heights finds where lines begin.
All spacing is windows over the lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FALLBACK = 4.8  # the spacing of usual 12 point type
PAGE = ("doc_id", "page_no")


def line_groups(chars: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """chars with line (from 0, top first) and place (from 0, by x0): a line holds what is within the tolerance of its first character's height."""

    def fold(state: Column, y: Column) -> Column:
        same = F.coalesce(F.abs(state["first"] - y) <= tolerance, F.lit(False))
        line = F.when(same, state["line"]).otherwise(state["line"] + 1)
        return F.struct(F.when(same, state["first"]).otherwise(y).alias("first"), line.alias("line"), F.concat(state["lines"], F.array(line)).alias("lines"))

    df = chars.select(*PAGE, "text", "x0", "x1", F.col("y1").cast("double").alias("y1"))
    heights = df.groupBy(*PAGE).agg(F.sort_array(F.collect_set("y1"), False).alias("heights"))
    empty = F.struct(F.lit(None).cast("double").alias("first"), F.lit(-1).alias("line"), F.array().cast("array<int>").alias("lines"))
    # a height's line once, and then its characters
    lines = heights.select(*PAGE, F.explode(F.arrays_zip("heights", F.aggregate("heights", empty, fold)["lines"].alias("lines"))).alias("z"))
    df = df.join(lines.select(*PAGE, F.col("z.heights").alias("y1"), F.col("z.lines").alias("line")), [*PAGE, "y1"]).select(*PAGE, "text", "x0", "x1", "y1", "line")
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*PAGE, "line").orderBy("x0", F.desc("y1"))) - 1)


def spacing(lines: DataFrame) -> DataFrame:
    """The lines' characters with center, is_space and spacing: the median distance of neighbours that are no space, if above 0 and below 50."""
    line = (*PAGE, "line")
    df = lines.withColumns({"center": (F.col("x0") + F.col("x1")) / 2, "is_space": F.col("text") == " "})
    visible = Window.partitionBy(*line, "is_space").orderBy("place")
    gap = F.when(~F.col("is_space"), F.col("center") - F.lag("center").over(visible))
    df = df.withColumn("gap", gap).withColumn("gap", F.when((F.col("gap") > 0) & (F.col("gap") < 50), F.col("gap")))
    return df.withColumn("spacing", F.coalesce(F.percentile("gap", 0.5).over(Window.partitionBy(*line)), F.lit(FALLBACK))).drop("gap")


def separators(df: DataFrame, keep: Column, space: Column, tab: Column | None) -> DataFrame:
    """Adds out: the character, or nothing for a space that stands too narrow, and a space or tab where the next one is far."""
    order = Window.partitionBy(*PAGE, "line").orderBy("place")
    seen = F.when(~F.col("is_space"), F.col("center"))
    before = F.last(seen, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(seen, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    df = df.withColumns({"before": before, "after": after, "next": F.lead("center").over(order), "next_space": F.lead("is_space").over(order)})
    far = F.col("next") - F.col("center")
    kept = F.when(F.col("before").isNull() | F.col("after").isNull() | (F.col("after") - F.col("before") >= keep), " ").otherwise("")
    added = F.when(F.coalesce("next_space", F.lit(True)), "")
    if tab is not None:
        added = added.when(far >= tab, "\t")
    added = added.when(far >= space, " ").otherwise("")
    return df.withColumn("out", F.when(F.col("is_space"), kept).otherwise(F.concat("text", added)))


def assembled(df: DataFrame) -> DataFrame:
    """doc_id, page_no, text: the lines that are not blank, one below another."""
    ordered = lambda key, value: F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value])
    lines = df.groupBy(*PAGE, "line").agg(F.array_join(ordered("place", "out"), "").alias("line_text"))
    lines = lines.where(F.regexp_replace("line_text", r"\s", "") != "")
    return lines.groupBy(*PAGE).agg(F.array_join(ordered("line", "line_text"), "\n").alias("text"))


def page_texts(chars: DataFrame, keep: float = 1.3, space: float = 1.1, tab: float = 1.3, tolerance: float = 2.0, fixed_keep: float | None = None, fixed_space: float | None = None) -> DataFrame:
    """doc_id, page_no, text. Thresholds are multiples of the line's spacing; with fixed_keep or fixed_space they are distances (6.0 and 5.3), and no tab is set."""
    df = line_groups(chars, tolerance)
    if fixed_keep is not None or fixed_space is not None:
        df = df.withColumns({"center": (F.col("x0") + F.col("x1")) / 2, "is_space": F.col("text") == " "})
        return assembled(separators(df, F.lit(fixed_keep or 6.0), F.lit(fixed_space or 5.3), None))
    unit = F.col("spacing")
    return assembled(separators(spacing(df), unit * keep, unit * space, unit * tab))
