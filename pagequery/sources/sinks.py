"""Outputs: selected pages by document, group or page, TSV tables and text, and what to do about outputs that exist."""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequery.errors import ConflictError
from pagequery.functions.names import clean_cell
from pagequery.operators import groups
from pagequery.storage import stored

MODES = ("single", "grouped", "separate")
#: What to do about an output that exists, as Spark's save modes; ask stands for rename where nobody can be asked.
SAVE = {"overwrite": "overwrite", "skip": "ignore", "fail": "errorifexists"}


def outputs(selection: DataFrame, pages: DataFrame, mode: str = "single", strategy: str | None = None) -> DataFrame:
    """The selected pages with output and out_ix: one output a document (single), group (grouped) or page (separate)."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    strategy = groups.default_strategy(strategy, mode == "grouped")
    rows = groups.with_order(groups.dedup(selection, strategy)) if mode != "grouped" else groups.dedup(selection, strategy)
    order = Window.partitionBy("doc_id").orderBy("group_ix", "pos", "page_no")
    if mode == "single":
        rows = rows.withColumns({"output": F.col("doc_id").cast("string"), "out_ix": F.row_number().over(order)})
    elif mode == "grouped":
        in_group = Window.partitionBy("doc_id", "group_ix").orderBy("pos", "page_no")
        rows = rows.withColumns({"output": F.format_string("%s_group%02d", F.col("doc_id"), F.col("group_ix")), "out_ix": F.row_number().over(in_group)})
    else:
        rows = rows.withColumns({"output": F.format_string("%s_page%02d", F.col("doc_id"), F.col("page_no")), "out_ix": F.lit(1)})
    return rows.select("doc_id", "group_ix", "output", "out_ix", "page_no").join(pages, ["doc_id", "page_no"])


def split_to_pages(pages: DataFrame) -> DataFrame:
    """One output a page, of documents with more than one."""
    n = F.max("page_no").over(Window.partitionBy("doc_id"))
    return pages.withColumn("__n", n).where("__n > 1").drop("__n").withColumn("output", F.format_string("%s_page%02d", F.col("doc_id"), F.col("page_no")))


def existing_outputs(spark: SparkSession, path: str, by: str = "output") -> DataFrame:
    """name: the outputs that a folder holds."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "name string")
    return spark.read.schema(f"`{by}` string").parquet(path).select(F.col(by).alias("name")).distinct()


def decided(planned: DataFrame, existing: DataFrame, conflict: str) -> DataFrame:
    """name, action, final_name for each planned(name), which are distinct: create, or what the strategy does to one that exists in any case.

    rename (and ask, where nobody can be asked) gives the least number that neither an output nor a planned one has: _1, _2 and so on."""
    if conflict not in (*SAVE, "rename", "ask"):
        raise ValueError(f"unknown conflict strategy: {conflict}")
    action = "rename" if conflict == "ask" else conflict
    names = planned.select("name", F.lower("name").alias("__name"))
    have = existing.select(F.lower("name").alias("__have")).distinct()
    taken = have.select(F.col("__have").alias("__taken")).unionByName(names.select(F.col("__name").alias("__taken"))).distinct()
    number = r"^(.*)_(\d{1,9})$"
    used = taken.where(F.col("__taken").rlike(number)).groupBy(F.regexp_extract("__taken", number, 1).alias("__stem")).agg(F.collect_set(F.regexp_extract("__taken", number, 2).cast("int")).alias("__used"))
    joined = names.join(have, F.col("__name") == F.col("__have"), "left").join(used, F.col("__name") == F.col("__stem"), "left")
    free = F.array_min(F.array_except(F.sequence(F.lit(1), F.coalesce(F.size("__used"), F.lit(0)) + 1), F.coalesce("__used", F.array().cast("array<int>"))))
    found = F.col("__have").isNotNull()
    final = F.when(found & F.lit(action == "rename"), F.concat("name", F.lit("_"), free.cast("string"))).otherwise(F.col("name"))
    return joined.select("name", F.when(found, action).otherwise("create").alias("action"), final.alias("final_name"))


def write_outputs(rows: DataFrame, path: str, conflict: str = "fail", by: str = "output") -> DataFrame:
    """Writes Parquet, one folder an output, and gives the decisions: name, action, final_name.

    Each output that exists already is overwritten, skipped or renamed by itself, by a join with the folder's listing in the job that writes; fail
    writes nothing and names the first ten. Spark stages the outputs and moves them when all tasks have ended, so a lost task leaves none half-written, and no other output is touched."""
    spark = rows.sparkSession
    plan = stored(decided(rows.select(F.col(by).alias("name")).distinct(), existing_outputs(spark, path, by), conflict), "decisions")
    if conflict == "fail" and (found := [r["name"] for r in plan.where("action = 'fail'").orderBy("name").limit(10).collect()]):
        raise ConflictError(f"{path} holds {', '.join(found)}", [f"{path}/{by}={x}" for x in found])
    kept = plan.where("action <> 'skip'").select(F.col("name").alias("__planned"), F.col("final_name").alias("__final"))
    out = rows.join(kept, F.col(by) == F.col("__planned")).withColumn(by, F.col("__final")).drop("__planned", "__final")
    out.write.partitionBy(by).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    return plan


def path_exists(spark: SparkSession, path: str) -> bool:
    """On whatever file system the path is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def resolved(path: str, conflict: str, exists=os.path.exists) -> str:
    if conflict not in (*SAVE, "rename", "ask"):
        raise ValueError(f"unknown conflict strategy: {conflict}")
    if conflict == "fail" and exists(path):
        raise ConflictError(f"{path} exists", [path])
    return unique_name(path, exists) if conflict in ("rename", "ask") else path


def unique_name(path: str, exists=os.path.exists) -> str:
    """The path, or with _1 to _999 before its extension, or with the time."""
    if not exists(path):
        return path
    stem, extension = os.path.splitext(path)
    free = (f"{stem}_{i}{extension}" for i in range(1, 1000))
    return next((p for p in free if not exists(p)), f"{stem}_{int(time.time())}{extension}")


def copy_name(path: str, exists=os.path.exists) -> str:
    """The path, or with _copy_01 and so on."""
    stem, extension = os.path.splitext(path)
    i, out = 0, path
    while exists(out):
        i += 1
        out = f"{stem}_copy_{i:02d}{extension}"
    return out


def conflicts(planned: DataFrame, existing: DataFrame) -> DataFrame:
    """name, existing_name, exact: planned names that exist, in any case."""
    found = existing.select(F.col("name").alias("existing_name"))
    joined = planned.select("name").join(found, F.lower("name") == F.lower("existing_name"))
    return joined.withColumn("exact", F.col("name") == F.col("existing_name"))


def without_collisions(planned: DataFrame) -> DataFrame:
    """planned(name) with final_name: the second and later ones of a name get _copy_01 and so on, in the order of the input.

    A name's rows are numbered within the task that they came from, and after those of the tasks before: no task gathers a name. Tasks and places are stored, so that counts and rows belong together."""
    dealt = stored(planned.withColumns({"__name": F.lower("name"), "__task": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "planned")
    counts = dealt.groupBy("__name", "__task").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__name").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("__name").alias("__of"), F.col("__task").alias("__in"), before.alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__name", "__task").orderBy("__at"))
    joined = dealt.withColumn("__ix", inside).join(counts, F.col("__name").eqNullSafe(F.col("__of")) & (F.col("__task") == F.col("__in")))
    ix = F.col("__ix") + F.col("__before") - 1
    stem, extension = F.regexp_extract("name", r"(?s)^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("name", r"(?s)^(.*?)(\.[^.]*)?$", 2)
    return joined.select(*planned.columns, F.when(ix == 0, F.col("name")).otherwise(F.format_string("%s_copy_%02d%s", stem, ix, extension)).alias("final_name"))


def free_basename(names: list[str], base: str) -> str:
    """A base name under which none of the names exists."""
    lower, out, i = {n.lower() for n in names}, base, 1
    while any(n.startswith(out.lower()) for n in lower):
        out, i = f"{base}_{i}", i + 1
    return out


def plan_operations(planned: DataFrame, existing: DataFrame, conflict: str) -> DataFrame:
    """name, action: create, or what the strategy does to a name that exists."""
    found = conflicts(planned, existing).select("name").distinct().withColumn("__found", F.lit(True))
    return planned.select("name").join(found, "name", "left").select("name", F.when(F.col("__found"), conflict).otherwise("create").alias("action"))


# --- tables and text --------------------------------------------------------------------------------------------------


def cleaned(df: DataFrame) -> DataFrame:
    return df.select(*(clean_cell(F.col(f"`{c}`")).alias(c) for c in df.columns))


def write_tsv(df: DataFrame, path: str, append: bool = False) -> None:
    """Cells cleaned, tab separated, with a header."""
    cleaned(df).write.option("sep", "\t").option("header", not append).option("quote", "").mode("append" if append else "overwrite").csv(path)


def preview_table(df: DataFrame, rows: int = 5) -> DataFrame:
    """The first rows as they would be written: the limit is the feature."""
    return cleaned(df).limit(rows)


def validate_table(df: DataFrame) -> list[str]:
    """What keeps a table from being written."""
    out = [] if df.columns else ["no columns"]
    names = [c.strip() for c in df.columns]
    out += ["a column without a name"] if "" in names else []
    return out + (["columns of one name"] if len(set(names)) < len(names) else [])


def dumped_text(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, value: a page's text below a line that names it."""
    head = F.format_string("=== %s, page %d ===\n", F.col("doc_id"), F.col("page_no"))
    return pages.select("doc_id", "page_no", F.concat(head, F.coalesce("text", F.lit(""))).alias("value"))


def dump_text(pages: DataFrame, path: str) -> None:
    """Text files of pages in order, which ``relations.read_dump`` reads again: lines that look like a page's first line, and a last line that is empty, are escaped by a backslash."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?md)^(=== |\\)", r"\\$1")
    text = F.when(F.endswith(text, F.lit("\n")), F.concat(text, F.lit("\\"))).otherwise(text)
    dumped_text(pages.withColumn("text", text)).orderBy("doc_id", "page_no").select("value").write.mode("overwrite").text(path)
