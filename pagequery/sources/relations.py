"""Page relations: doc_id, page_no (1..n, dense), text, image_count, size_bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequery.storage import stored

PAGE_SCHEMA = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("page_no", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("image_count", T.IntegerType()), T.StructField("size_bytes", T.LongType())])


def page_relation(df: DataFrame, doc_id: Column, page_no: Column, text: Column, image_count: Column | None = None, *more: Column) -> DataFrame:
    """Null text becomes empty; a page's size is that of its text unless the source knows better."""
    text = F.coalesce(text, F.lit(""))
    images = F.lit(0) if image_count is None else image_count
    return df.select(doc_id.cast("string").alias("doc_id"), page_no.cast("int").alias("page_no"), text.alias("text"), images.cast("int").alias("image_count"), F.octet_length(text).cast("long").alias("size_bytes"), *more)


def checked(pages: DataFrame) -> DataFrame:
    """The relation, if it has the columns it needs."""
    missing = {f.name for f in PAGE_SCHEMA} - set(pages.columns)
    if missing:
        raise ValueError(f"a page relation lacks {', '.join(sorted(missing))}")
    return pages


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a document, a turn a page."""
    return page_relation(read(spark, sf_dir, "conversations"), F.col("conv_id"), F.col("turn") + 1, F.col("text"), F.length("text") % 3, F.col("role"))


PAGES_EACH = 1 << 18  # rows that one task puts in order


def numbered(df: DataFrame, key: str, order: str, name: str, each: int = PAGES_EACH) -> DataFrame:
    """df with name: the row's number, from 1, among those of its key in an order.

    More than each rows are dealt out by ranges of (key, order) of about each rows, whatever the values, and stored, so that a range is the same rows whenever
    it is read. Rows are ordered within a range, and ranges have their counts summed: a key with any share of the rows is spread over tasks."""
    n = df.count()
    if n <= each:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(order)))
    dealt = stored(df.repartitionByRange(-(-n // each), key, order).withColumn("__part", F.spark_partition_id()), "ranges")
    inside = F.row_number().over(Window.partitionBy(key, "__part").orderBy(order))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__key").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = dealt.groupBy(F.col(key).alias("__key"), F.col("__part").alias("__of")).agg(F.count(F.lit(1)).alias("__n")).select("__key", "__of", before.alias("__before"))
    joined = dealt.withColumn(name, inside).join(counts, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__of")))
    return joined.withColumn(name, F.col(name) + F.col("__before")).select(*df.columns, name)


def source_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source is a document, its texts are the pages by their id. Few and long documents."""
    df = numbered(read(spark, sf_dir, "documents").select("source", "doc_id", "text"), "source", "doc_id", "page_no")
    return page_relation(df, F.col("source"), F.col("page_no"), F.col("text"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text is a document, a line a page."""
    df = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return page_relation(df, F.col("doc_id"), F.col("line") + 1, F.col("text"))


def read_dump(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """The pages of text dumps (``sinks.dump_text``) in a folder, or of those that arrive there. Files are split at their pages' first lines, so a large one is many tasks."""
    reader = spark.readStream if stream else spark.read
    records = reader.option("lineSep", "\n=== ").text(path)
    head = r"(?s)^(?:=== )?([^\n]*), page (\d+) ===\n(.*)$"
    part = lambda i: F.regexp_extract("value", head, i)
    text = F.regexp_replace(F.regexp_replace(part(3), r"\n\z", ""), r"(?md)^\\", "")
    return page_relation(records.where(F.col("value").rlike(head)), part(1), part(2), text)


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A web page is a document of one page; its images are its img elements."""
    images = F.size(F.split("html", "(?i)<img")) - 1
    return page_relation(read(spark, sf_dir, "pages"), F.col("page_id"), F.lit(1), F.col("html"), images)


def text_pages(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A relation of (doc_id, page_no, text[, image_count[, size_bytes]]) rows."""
    full = []
    for r in rows:
        doc_id, page_no, text, *rest = r
        images = rest[0] if rest else 0
        full.append((doc_id, page_no, text or "", images, rest[1] if len(rest) > 1 else len((text or "").encode())))
    return spark.createDataFrame(full, PAGE_SCHEMA)


def document_info(pages: DataFrame) -> DataFrame:
    """doc_id, page_count, size_mb"""
    return pages.groupBy("doc_id").agg(F.max("page_no").alias("page_count"), (F.sum("size_bytes") / 1048576).alias("size_mb"))
