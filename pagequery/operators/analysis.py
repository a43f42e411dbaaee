"""What a collection's pages are like: types, sizes, samples and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequery.functions.classify import MEANINGFUL, confidence, page_type
from pagequery.functions.text import collapse, non_blank_lines, trim_ws
from pagequery.sources.relations import document_info

MB = 1048576


def analyze(pages: DataFrame) -> DataFrame:
    """A row a page: number, type, sizes, text length, images, whether its text is meaningful, and how sure the type is."""
    text, images = F.col("text"), F.col("image_count")
    n = F.length(trim_ws(F.coalesce(text, F.lit(""))))
    return pages.select(
        "doc_id",
        F.col("page_no").alias("page_number"),
        page_type(text, images).alias("page_type"),
        "size_bytes",
        (F.col("size_bytes") / 1024).alias("size_kb"),
        (F.col("size_bytes") / MB).alias("size_mb"),
        n.alias("text_length"),
        F.coalesce(images, F.lit(0)).alias("image_count"),
        (n >= MEANINGFUL).alias("has_meaningful_text"),
        confidence(text, images).alias("confidence"),
    )


def summary(pages: DataFrame) -> DataFrame:
    """doc_id, total_pages, total_size, average_size (whole bytes)"""
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_pages"), F.sum("size_bytes").alias("total_size"), F.floor(F.sum("size_bytes") / F.count(F.lit(1))).alias("average_size"))


TYPES = ("text", "mixed", "image", "empty")


def type_distribution(pages: DataFrame) -> DataFrame:
    """doc_id, type_ix (the order of a report), page_type, n, percent, average_size; types without a page have no row."""
    kinds = pages.select("doc_id", "size_bytes", page_type(F.col("text"), F.col("image_count")).alias("page_type"))
    per = kinds.groupBy("doc_id", "page_type").agg(F.count(F.lit(1)).alias("n"), F.floor(F.sum("size_bytes") / F.count(F.lit(1))).alias("average_size"))
    order = F.array_position(F.array(*map(F.lit, TYPES)), F.col("page_type")).cast("int")
    return per.select("doc_id", order.alias("type_ix"), "page_type", "n", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("doc_id")), 1).alias("percent"), "average_size")


BINS = ((50 * 1024, "<50KB"), (200 * 1024, "50-200KB"), (MB, "200KB-1MB"), (5 * MB, "1-5MB"))


def size_bin(size: Column) -> Column:
    out = F.lit(">=5MB")
    for limit, name in reversed(BINS):
        out = F.when(size < limit, name).otherwise(out)
    return out


def size_histogram(pages: DataFrame) -> DataFrame:
    """doc_id, size_bin, n"""
    return pages.groupBy("doc_id", size_bin(F.col("size_bytes")).alias("size_bin")).agg(F.count(F.lit(1)).alias("n"))


def sample_text(text: Column, most: int = 30) -> Column:
    """In quotes, the first sentence of over 10 characters, or the start of the text; cut with an ellipsis. Null for short texts."""
    flat = collapse(F.coalesce(text, F.lit("")))
    sentence = F.get(F.filter(F.transform(F.split(flat, "[.!?]+"), trim_ws), lambda s: F.length(s) > 10), F.lit(0))
    chosen = F.coalesce(sentence, flat)
    cut = F.when(F.length(chosen) > most, F.concat(F.left(chosen, F.lit(most - 3)), F.lit("..."))).otherwise(chosen)
    return F.when(F.length(trim_ws(F.coalesce(text, F.lit("")))) >= 20, F.concat(F.lit('"'), cut, F.lit('"')))


def sample_content(text: Column, images: Column) -> Column:
    """A page in a few words, by its type (fixed wording)."""
    kind, n = page_type(text, images), F.length(trim_ws(F.coalesce(text, F.lit(""))))
    pictures = F.when(images == 1, "(Single image/scan)").otherwise(F.format_string("(%d images/scanned content)", images))
    mixed = F.format_string("(Mixed: %s chars + %2d images)", F.lpad(F.format_number(n, 0), 5, " "), images)
    out = F.when(kind == "empty", "(Empty or minimal content)").when(kind == "image", pictures).when(kind == "mixed", mixed)
    return out.when(n > 500, "(Substantial text content)").otherwise("(Text content)")


def page_table(pages: DataFrame) -> DataFrame:
    """The report's row for each page."""
    return pages.select("doc_id", F.col("page_no").alias("page"), page_type(F.col("text"), F.col("image_count")).alias("page_type"), "size_bytes", sample_content(F.col("text"), F.col("image_count")).alias("content"))


def document_analysis(pages: DataFrame, looked_at: int = 3) -> DataFrame:
    """doc_id, page_count, size_mb, mb_per_page, and whether the first pages have text or images."""
    early = F.col("page_no") <= looked_at
    return pages.groupBy("doc_id").agg(
        F.max("page_no").alias("page_count"),
        (F.sum("size_bytes") / MB).alias("size_mb"),
        (F.sum("size_bytes") / MB / F.max("page_no")).alias("mb_per_page"),
        F.bool_or(early & (trim_ws(F.coalesce("text", F.lit(""))) != "")).alias("has_text"),
        F.bool_or(early & (F.coalesce("image_count", F.lit(0)) > 0)).alias("has_images"),
    )


def large_documents(pages: DataFrame, size_mb: float = 1.0, per_page_mb: float = 0.5) -> DataFrame:
    return document_analysis(pages).where((F.col("size_mb") > size_mb) | (F.col("mb_per_page") > per_page_mb))


def malformed(pages: DataFrame) -> DataFrame:
    """doc_id, kind: documents one of whose first three pages refers to at least half as many images as the document has pages."""
    n = F.max("page_no").over(Window.partitionBy("doc_id"))
    hit = pages.select("doc_id", "page_no", "image_count").withColumn("n", n).where((F.col("page_no") <= 3) & (F.col("image_count") > 0) & (F.col("image_count") >= 0.5 * F.col("n")))
    return hit.select("doc_id").distinct().withColumn("kind", F.lit("Resource duplication"))


def malformation_summary(pages: DataFrame) -> DataFrame:
    return malformed(pages).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def listing(pages: DataFrame) -> DataFrame:
    """doc_id, page_count, size_mb, kind (single or multi), malformed: the list of documents."""
    bad = malformed(pages).select("doc_id", F.lit(True).alias("malformed"))
    return document_info(pages).join(bad, "doc_id", "left").select("doc_id", "page_count", "size_mb", F.when(F.col("page_count") > 1, "multi").otherwise("single").alias("kind"), F.coalesce("malformed", F.lit(False)).alias("malformed"))


def text_counts(pages: DataFrame) -> DataFrame:
    """doc_id, pages_with_text, non_blank_lines"""
    n = F.size(non_blank_lines(F.coalesce("text", F.lit(""))))
    return pages.groupBy("doc_id").agg(F.sum((n > 0).cast("long")).alias("pages_with_text"), F.sum(n).alias("non_blank_lines"))


def table_stats(df: DataFrame) -> DataFrame:
    """rows, columns, empty_cells, filled_cells, fill_rate of a table of strings."""
    empty = sum((F.sum((trim_ws(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) == "").cast("long")) for c in df.columns), F.lit(0))
    n = F.count(F.lit(1)) * len(df.columns)
    out = df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"), F.coalesce(empty, F.lit(0)).alias("empty_cells"), n.alias("cells"))
    return out.select("rows", "columns", "empty_cells", (F.col("cells") - F.col("empty_cells")).alias("filled_cells"), F.when(F.col("cells") > 0, (F.col("cells") - F.col("empty_cells")) / F.col("cells")).otherwise(0.0).alias("fill_rate"))


def warning_counts(messages: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """kind, n: how many messages(message) contain the text of each kind; the first that fits."""
    kind = F.lit("other")
    for name, text in reversed(kinds.items()):
        kind = F.when(F.contains(F.lower("message"), F.lit(text.lower())), name).otherwise(kind)
    return messages.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
