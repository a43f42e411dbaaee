"""Exact nearest neighbours by cosine, as a block matrix join.

Unit vectors are rounded to int8 with a scale of their own, once a row, and packed into blocks of binary rows. Only these blocks meet:
a query block (up to ``query_rows``) goes to every slot, a candidate block to one slot of every query block, so tasks are even
whatever the data, and what moves is a byte a component. In a tile the integer products are exact (held in float32 over at most 1024
dimensions at a time) and give each pair a cosine with a proven error bound:

    x = a + e with a the rounded vector, |e| = r  =>  |<x,y> - <a,b>| <= |a| s + r |y|   (s: the residual of y)

A pair whose upper bound is below the k-th best lower bound of its query cannot be among the k nearest and is discarded, in its
slot and again over all slots. Survivors, a little over k a query, fetch the original vectors by the rows' keys, are recomputed in double precision and
enter the query's heap. Of more than k + 1 copies of one vector only the k + 1 of least vec_id are candidates, since the others cannot be among the nearest.
Nothing is sampled or approximated: the result is that of brute force.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows with a null
vec_id. Ties go to the smaller vec_id. A query never meets its own row, but any other, those of the same vec_id included. Vectors of different lengths never meet. Exact
copies are candidates of their own. Fewer than k candidates: all of them. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ROW, stored, table

BLOCK = "part int, ix int, dim int, n int, rows binary, q binary, scale binary, size binary, residual binary"
WIDEST = 1024  # 127 * 127 * 1024 < 2**24: sums of int8 products that float32 holds exactly


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows in double precision, by powers of two: exact, and no square overflows."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


class Block:
    """Rows in int8, with what bounds their errors: scale, the rounded vector's size and that of what rounding took."""

    def __init__(self, rows: np.ndarray, q: np.ndarray, scale: np.ndarray, size: np.ndarray, residual: np.ndarray):
        self.rows, self.q, self.scale, self.size, self.residual = rows, q, scale, size, residual

    @classmethod
    def of(cls, rows: np.ndarray, x: np.ndarray) -> Block:
        x = scaled(x)
        unit = x / np.sqrt((x * x).sum(1, keepdims=True))
        scale = np.abs(unit).max(1, keepdims=True) / 127
        q = np.rint(unit / scale)
        rounded = q * scale
        size = np.sqrt((rounded**2).sum(1)) * (1 + 1e-12)
        return cls(rows, q.astype(np.int8), scale[:, 0], size, np.sqrt(((unit - rounded) ** 2).sum(1)) * (1 + 1e-12) + 1e-12)

    @classmethod
    def read(cls, row: dict) -> Block:
        doubles = (np.frombuffer(row[k], "<f8") for k in ("scale", "size", "residual"))
        return cls(np.frombuffer(row["rows"], "<i8"), np.frombuffer(row["q"], np.int8).reshape(-1, row["dim"]), *doubles)

    def part(self, a: int, b: int) -> Block:
        return Block(*(v[a:b] for v in (self.rows, self.q, self.scale, self.size, self.residual)))

    def bytes(self) -> tuple:
        return (self.q.shape[1], len(self.rows), *(v.tobytes() for v in (self.rows, self.q, self.scale, self.size, self.residual)))

    def product(self, other: Block) -> np.ndarray:
        total = None
        for a in range(0, self.q.shape[1], WIDEST):
            part = self.q[:, a : a + WIDEST].astype(np.float32) @ other.q[:, a : a + WIDEST].astype(np.float32).T
            total = part if total is None else total + part.astype(np.float64)
        return total


def packed(df: DataFrame, rows: int) -> DataFrame:
    """Blocks of up to so many vectors of one length of df(row, embedding)."""

    def run(batches):
        part, held, ix = TaskContext.get().partitionId(), {}, 0
        kinds = [pa.int32()] * 4 + [pa.binary()] * 5

        def out(dim: int) -> pa.RecordBatch:
            nonlocal ix
            keys, vectors = held.pop(dim)
            ix += 1
            made = (part, ix, *Block.of(np.array(keys, "<i8"), np.array(vectors)).bytes())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(made, kinds, strict=True)], [x.split()[0] for x in BLOCK.split(", ")])

        for batch in batches:
            values = batch.column("embedding")
            for key, v in zip(batch.column(ROW).to_pylist(), values, strict=True):
                v = v.values.to_numpy(zero_copy_only=False)
                keys, vectors = held.setdefault(len(v), ([], []))
                keys.append(key)
                vectors.append(v)
                if len(keys) >= rows:
                    yield out(len(v))
        for dim in list(held):
            yield out(dim)

    return df.select(ROW, "embedding").mapInArrow(run, BLOCK)


def in_order(terms: np.ndarray) -> np.ndarray:
    """Row sums from left to right, so that copies tie exactly."""
    return np.cumsum(terms, 1)[:, -1]


class Search:
    """The search of a query block through candidate blocks: for each query its k best lower bounds, and the pairs that may yet be among the k nearest."""

    def __init__(self, queries: Block, k: int, step: int = 1024):
        self.k, self.step = k, step
        self.parts = [queries.part(a, a + step) for a in range(0, len(queries.rows), step)]
        self.best = [np.full((len(p.rows), k), -np.inf) for p in self.parts]  # lower bounds
        self.pairs: list[list] = [[] for _ in self.parts]

    def meet(self, candidates: Block) -> None:
        for i, (p, best) in enumerate(zip(self.parts, self.best, strict=True)):
            dots = p.product(candidates) * (p.scale[:, None] * candidates.scale[None, :])
            slack = p.size[:, None] * candidates.residual[None, :] + p.residual[:, None] + 1e-9
            own = p.rows[:, None] == candidates.rows[None, :]
            lower = np.where(own, -np.inf, dots - slack)
            top = np.partition(lower, lower.shape[1] - self.k, 1)[:, -self.k :] if lower.shape[1] > self.k else lower
            both = np.concatenate([best, top], 1)
            self.best[i] = best = np.partition(both, both.shape[1] - self.k, 1)[:, -self.k :]
            upper = dots + slack
            q, c = np.nonzero((upper >= best.min(1)[:, None]) & ~own)
            self.pairs[i].append((q, candidates.rows[c], upper[q, c]))

    def survivors(self) -> pa.Table:
        """query_row, row, upper, bound: pairs whose upper bound is no less than the slot's k-th best lower bound, the bound."""
        out = []
        for p, best, pairs in zip(self.parts, self.best, self.pairs, strict=True):
            q, rows, upper = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            bound = best.min(1)[q]
            keep = upper >= bound
            out.append(pa.table([pa.array(v[keep]) for v in (p.rows[q], rows, upper, bound)], names=["query_row", "row", "upper", "bound"]))
        return pa.concat_tables(out)


def heaps_of(df: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of df(query_row, query_id, query, vec_id, embedding): scores in double precision, the k largest of each query."""

    def scores(batch: pa.RecordBatch) -> np.ndarray:
        q, c = (batch.column(x) for x in ("query", "embedding"))
        size = np.array([len(v) for v in q], np.int64)
        out = np.empty(len(size))
        for dim in np.unique(size):
            at = np.nonzero(size == dim)[0]
            x, y = (scaled(v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)) for v in (q, c))
            out[at] = np.clip(in_order(x * y) / np.sqrt(in_order(x * x) * in_order(y * y)), -1, 1)
        return out

    def run(batches):
        now, query, heap = None, None, []

        def done() -> list[tuple]:
            return [(query, rank, -vec_id, score) for rank, (score, vec_id) in enumerate(sorted(heap, reverse=True), 1)]

        for batch in batches:
            rows = []
            for row, query_id, vec_id, score in zip(batch.column("query_row").to_pylist(), batch.column("query_id").to_pylist(), batch.column("vec_id").to_pylist(), scores(batch).tolist(), strict=True):
                if row != now:
                    rows += done()
                    now, query, heap = row, query_id, []
                (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (score, -vec_id))
            yield result(rows)
        yield result(done())

    def result(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)], ["query_id", "rank", "vec_id", "score"])

    return df.repartition("query_row").sortWithinPartitions("query_row").mapInArrow(run, "query_id long, rank int, vec_id long, score double")


def nearest(embeddings: DataFrame, every: int = 50, k: int = 5, query_rows: int = 1 << 16, candidate_rows: int = 4096, slot_rows: int = 1 << 18) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of embeddings(vec_id, embedding) for each row whose vec_id is divisible by every.

    With n rows a component of a candidate moves n / (every * query_rows) times, as a byte; larger executors can take larger blocks."""
    spark = embeddings.sparkSession
    parts = F.coalesce("embedding", F.array().cast(embeddings.schema["embedding"].dataType))
    finite = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    taking_part = F.col("vec_id").isNotNull() & (F.size(parts) > 0) & finite & F.exists(parts, lambda x: x != 0)
    # numbered once and stored: each reading gives each row the same key
    valid = stored(embeddings.where(taking_part).select(F.monotonically_increasing_id().alias(ROW), "vec_id", "embedding"), "vectors")
    asked = valid.where(F.col("vec_id") % every == 0)
    n, n_queries = valid.agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0)).first()
    queries = stored(packed(asked.repartition(max(1, -(-n_queries // query_rows))), query_rows), "queries")
    # of copies those of least vec_id, known by 128 bits of hashes; the limit on the rank is applied before the exchange too
    copies = Window.partitionBy(F.xxhash64("embedding"), F.xxhash64(F.lit("again"), "embedding")).orderBy("vec_id", ROW)
    candidates = packed(valid.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1), candidate_rows)
    slots = max(2 * spark.sparkContext.defaultParallelism, -(-n // slot_rows))
    headers = queries.select("dim", F.struct("part", "ix").alias("block"))  # a few bytes for each query_rows queries
    left = queries.withColumn("block", F.struct("part", "ix")).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    right = candidates.withColumn("slot", F.pmod(F.xxhash64("part", "ix"), F.lit(slots)).cast("int")).join(F.broadcast(headers), "dim")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table([pa.array([], pa.int64())] * 2 + [pa.array([], pa.float64())] * 2, names=["query_row", "row", "upper", "bound"])
        if not len(left):
            return empty
        search = Search(Block.read(left.to_pylist()[0]), k)
        for i in range(len(right)):
            search.meet(Block.read(right.slice(i, 1).to_pylist()[0]))
        return search.survivors()

    keys = ("dim", "block", "slot")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_row long, row long, upper double, bound double")
    found = found.withColumn("bound", F.max("bound").over(Window.partitionBy("query_row"))).where(F.col("upper") >= F.col("bound")).select("query_row", "row")
    of_query = asked.select(F.col(ROW).alias("query_row"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    of_row = valid.select(F.col(ROW).alias("row"), "vec_id", "embedding")
    return heaps_of(stored(found, "survivors").join(of_row, "row").join(of_query, "query_row"), k)


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {"op4_nearest_neighbours": op4_nearest_neighbours}
ORACLE_SQL = {
    "op4_nearest_neighbours": """
        WITH v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                     AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
             s AS (SELECT q.r AS query_row, q.vec_id AS query_id, c.vec_id AS vec_id, list_cosine_similarity(q.e, c.e) AS score
                   FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r),
             r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
}
