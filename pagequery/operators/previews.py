"""What a batch of names would come to: previews, warnings and a summary, as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequery.functions import names
from pagequery.plans.template import missing_variables, required_variables

NO_MATCH = "No_Match"


def previews(values: DataFrame, template: str, stem: Column, page_range: Column, existing: DataFrame | None = None, preview: bool = True) -> DataFrame:
    """values with name, would_conflict, final_name and problems: the file name that a template makes of each row's columns.

    A variable without a value (null or No_Match) reads PREVIEW_NAME, or NO_NAME where names are made in earnest, and is a problem; so is one that
    the template asks for and nothing gives. Names that existing(name) holds in any case get the least free number."""
    from pagequery.sources.sinks import decided

    asked = [v for v in sorted(required_variables(template)) if v in values.columns]
    found = {v: F.nullif(F.col(f"`{v}`").cast("string"), F.lit(NO_MATCH)) for v in asked}
    whole = names.template_variables(found, stem, page_range, preview)
    made = names.fill_template(template, whole)
    made = F.when(F.lower(made).endswith(".pdf"), made).otherwise(F.concat(made, F.lit(".pdf")))
    lacking = [F.lit(f"{v} is not given") for v in missing_variables(template, set(asked))]
    problems = F.array_compact(F.array(*(F.when(found[v].isNull(), F.lit(f"{v} was not found")) for v in asked), *lacking)) if asked or lacking else F.array().cast("array<string>")
    out = values.withColumns({"name": made, "problems": problems})
    if existing is None:
        return out.withColumns({"would_conflict": F.lit(False), "final_name": F.col("name")})
    bare = lambda c: F.regexp_replace(c, r"(?i)\.pdf$", "")
    plan = decided(out.select(bare(F.col("name")).alias("name")).distinct(), existing.select(bare(F.col("name")).alias("name")), "rename")
    plan = plan.select(F.col("name").alias("__planned"), (F.col("action") == "rename").alias("would_conflict"), F.concat("final_name", F.lit(".pdf")).alias("final_name"))
    return out.join(plan, bare(F.col("name")) == F.col("__planned")).drop("__planned")


def warnings_of(previewed: DataFrame) -> DataFrame:
    """A row for each problem of each name: the columns of previewed, with problem."""
    return previewed.select("*", F.explode("problems").alias("problem")).drop("problems")


def batch_summary(previewed: DataFrame, batch: str, order: str, most: int = 10) -> DataFrame:
    """batch, n, failed, reasons (how many names have each problem, a map), first_failures (struct of order and problems of the first ``most``; the limit is the feature).

    Failures are ranked within parts of a batch before they meet, so a batch of any size sends a few rows from each part; counts are partial sums."""
    key = F.col(batch).alias("batch")
    counts = previewed.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("problems") > 0).alias("failed"))
    failed = previewed.where(F.size("problems") > 0)
    reasons = failed.select(key, F.explode("problems").alias("problem")).groupBy("batch", "problem").agg(F.count(F.lit(1)).alias("k"))
    reasons = reasons.groupBy(F.col("batch").alias("__a")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("problem", "k")))).alias("reasons"))
    dealt = failed.select(key, F.col(order).alias("order"), "problems").withColumn("__part", F.pmod(F.xxhash64("order"), F.lit(64)))
    for of in (("batch", "__part"), ("batch",)):
        dealt = dealt.withColumn("__place", F.row_number().over(Window.partitionBy(*of).orderBy("order", "problems"))).where(F.col("__place") <= most)
    first = dealt.groupBy(F.col("batch").alias("__b")).agg(F.array_sort(F.collect_list(F.struct("order", "problems"))).alias("first_failures"))
    joined = counts.join(reasons, F.col("batch").eqNullSafe(F.col("__a")), "left").join(first, F.col("batch").eqNullSafe(F.col("__b")), "left")
    return joined.select("batch", "n", "failed", "reasons", "first_failures")
