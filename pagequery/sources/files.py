"""Documents from files: folders of PDF files as a page relation. Decoding needs the optional package pypdf on the executors."""

from __future__ import annotations

import glob
import io
import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .relations import PAGE_SCHEMA

VALIDITY = "path string, valid boolean, error string, page_count int, encrypted boolean"


def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, content of the PDF files of a folder by name; hidden files are left out. No file is opened by the driver."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return df.where(~name.startswith(".") & (F.col("length") > 0)).select("path", name.alias("name"), "length", "content")


def scan_file(spark: SparkSession, path: str) -> DataFrame:
    """The same for one file, which must be named .pdf and hold something."""
    if not path.lower().endswith(".pdf"):
        raise ValueError(f"not a PDF file: {path}")
    df = spark.read.format("binaryFile").load(path).where("length > 0")
    return df.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content")


def expand_paths(patterns: list[str]) -> list[str]:
    """The PDF files that patterns name, once each, sorted."""
    found = {p for g in patterns for p in (glob.glob(g) or ([g] if os.path.exists(g) else []))}
    return sorted(p for p in found if p.lower().endswith(".pdf"))


def decoded(content: bytes) -> list[tuple[str, int]]:
    """(text, images) of each page; a page that cannot be read is empty, a file that cannot has no page."""
    from pypdf import PdfReader

    out = []
    try:
        reader = PdfReader(io.BytesIO(content))
        for page in reader.pages:
            try:
                out.append((page.extract_text() or "", len(page.images)))
            except Exception:  # one page of many: it counts as empty
                out.append(("", 0))
    except Exception:  # no PDF, or encrypted
        return []
    return out


def pages_of_files(files: DataFrame) -> DataFrame:
    """The page relation of files(path, length, content); a page's size is its share of the file."""

    def run(batches):
        for batch in batches:
            for path, length, content in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "content")), strict=True):
                rows = decoded(content)
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(range(1, n + 1), pa.int32()), pa.array([t for t, _ in rows], pa.string()), pa.array([i for _, i in rows], pa.int32()), pa.array([length // n] * n if n else [], pa.int64())], PAGE_SCHEMA.names)

    return files.select("path", "length", "content").mapInArrow(run, PAGE_SCHEMA)


def validity(files: DataFrame) -> DataFrame:
    """A row a file: whether it can be read, why not, its pages and whether it is encrypted."""

    def check(content: bytes) -> tuple:
        from pypdf import PdfReader

        try:
            reader = PdfReader(io.BytesIO(content))
            if reader.is_encrypted:
                return (False, "encrypted", 0, True)
            n = len(reader.pages)
            return (n > 0, None if n else "no pages", n, False)
        except Exception as e:  # whatever the decoder finds wrong is the result
            return (False, str(e), 0, False)

    def run(batches):
        for batch in batches:
            rows = [(p, *check(c)) for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True)]
            kinds = (pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in VALIDITY.split(", ")])

    return files.select("path", "content").mapInArrow(run, VALIDITY)


class PdfPages(DataSource):
    """spark.read.format("pdf_pages").option("paths", "a.pdf,b.pdf").load(): pages of files that the executors can open."""

    @classmethod
    def name(cls) -> str:
        return "pdf_pages"

    def schema(self):
        return PAGE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PdfReaderOfPaths([p.strip() for p in self.options.get("paths", self.options.get("path", "")).split(",") if p.strip()])


class PdfReaderOfPaths(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        with open(partition.value, "rb") as f:
            content = f.read()
        rows = decoded(content)
        for i, (text, images) in enumerate(rows, 1):
            yield (partition.value, i, text, images, len(content) // len(rows))
