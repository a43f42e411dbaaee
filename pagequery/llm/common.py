"""What the operators share: tables, the shared folder, row keys and word splitting."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import unicodedata
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The key of rows that have no natural one, in tables that hold no other column of an input but those named.
ROW = "__pq_row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of this session's own where that is unset and all runs on one machine."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="pagequery-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and its lineage cut.

    A reader that loses an executor reads the files again. ``discard`` removes it; the folder's owner removes the rest after the run."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/pagequery-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes stored tables that nothing reads any more: only what was made of them and is stored itself."""
    for df in tables:
        if path := getattr(df, "_stored_at", None):
            at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Plans of these nodes alone, over one table of Parquet files, give rows that the place in their file names for good.
SCANS = ("Relation", "Project", "Filter")


def settled(df: DataFrame) -> DataFrame:
    """df, or what it holds now as a stored table, unless it is read from Parquet files: every reading gives each row the same key.

    The key is the row's file and its index in there, so it does not depend on how a scan is split, which follows the executors at hand."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = [x.lstrip(" :+-!").split(" ")[0].split("[")[0] for x in plan.splitlines() if x.strip()]
    random = any(x in plan for x in ("rand(", "randn(", "uuid(", "monotonically_increasing_id", "spark_partition_id"))
    if all(x in SCANS for x in nodes) and plan.rstrip().endswith(" parquet") and not random:
        return df
    return stored(df, "input")


def row_key(df: DataFrame) -> Column:
    """The key of a row of a settled table: a hash of its file's path, and its index in the file."""
    of = df.metadataColumn("_metadata")
    return F.struct(F.xxhash64(of["file_path"]).alias("file"), of["row_index"].alias("row"))


#: The type of a row's key.
KEY = "struct<file: bigint, row: bigint>"


def numbered(df: DataFrame, *columns: str | Column) -> DataFrame:
    """ROW and these columns of a settled table."""
    return df.select(row_key(df).alias(ROW), *columns)


def free_name(df: DataFrame, name: str = ROW) -> str:
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def without(df: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of a settled table whose key is not in gone(row)."""
    row = free_name(df)
    gone = gone.select(F.col(gone.columns[0]).alias(free_name(df, "__pq_gone")))
    keyed = df.withColumn(row, row_key(df))
    return keyed.join(gone, keyed[row] == gone[gone.columns[0]], "left_anti").drop(row)


def category(first: str) -> str:
    """The characters of a Unicode category (all that begin so), as the inside of a character class."""
    runs, start = [], None
    for i in range(0x110001):
        inside = i < 0x110000 and unicodedata.category(chr(i))[0] == first
        if inside and start is None:
            start = i
        elif not inside and start is not None:
            runs.append(f"{chr(start)}-{chr(i - 1)}")
            start = None
    return "".join(runs)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def hashed_sample(df: DataFrame, most: int) -> list:
    """Rows of df of least hash, at most so many, in that order. What reaches the driver is a few times that, on any number of tasks."""
    kept = stored(df, "sample")
    total, names, scale = kept.count(), [f"`{c}`" for c in kept.columns], 1 << 30
    place = F.pmod(F.xxhash64(*names), F.lit(scale))
    if total > 4 * most:
        kept = kept.where(place < scale * 2 * most // total)
    return kept.orderBy(place, *names).limit(most).collect()


def release_shuffles(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of finished jobs now: it does so when the driver's JVM collects what nothing refers to any more."""
    spark.range(1).collect()  # the last job is let go when another has run
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release_heaps(spark: SparkSession) -> None:
    """Has the executors' JVMs give what earlier jobs left in their heaps back to the system, which G1 does in a full collection alone: a task for each core calls for one.

    Only memory depends on it: an executor that gets no task keeps what it has."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


def release_memory() -> None:
    """Gives what a Python worker has freed back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
