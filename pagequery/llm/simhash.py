"""Near-duplicates by SimHash, with pivot distance tables.

Fingerprints of 64 bits link at ``radius`` (3) or fewer differing bits; documents of one component form a group.

Distinct fingerprints are stored with a table of their Hamming distances to ``PIVOTS`` reference fingerprints (a byte each, eight to a
long), which goes with them wherever pairs meet. By the triangle
inequality two fingerprints within the radius differ by at most the radius in every coordinate, so a pair with a larger coordinate
difference is discarded unseen; what survives is verified on all bits. The distances of unrelated fingerprints to a reference
concentrate (32 with a deviation of 4, against a radius of 3), so that a coordinate alone halves the pairs at best, and no set of
them can replace a key to join by. Pairs therefore meet by key first: of ``radius + 1 + extra`` blocks of bits, those within the
radius agree on ``1 + extra`` blocks at least, so each choice of that many blocks is a key, and none is missed; ``extra`` grows with
the number of fingerprints, so that the rows of a key stay few. Within a key, pairs are never written out: the tile is
evaluated in place and yields a spanning forest of its links. Keys with more than ``TILE`` fingerprints are split into tiles by
pairs of parts, each a task of its own.

Defined results: a null or empty text (or one without words) has fingerprint zero and links like any other; fewer words than a shingle: the whole sequence
is one shingle. Repeated rows have the same fingerprint and group. component_id is the least doc_id of the group (null only where
all ids are null). An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEY, ROW, numbered, settled, stored, table, without
from .components import components

BITS, PIVOTS, TILE = 64, 24, 768
REFERENCES = np.array([xxhash.xxh64_intdigest(f"pivot {i}", 0) for i in range(PIVOTS)], np.uint64)


def fingerprint(text: str | None, words: int = 3) -> int:
    """Bits that are set in over half of the XXH64 (seed 42) of the shingles, repeats included."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    h = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], "<u8")
    ones = np.zeros(BITS, np.int64)
    for a in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, words: int = 3) -> DataFrame:
    """row, doc_id, fp (the fingerprint as a signed long) for each row of documents(doc_id, text)."""

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(ROW), batch.column("doc_id"), pa.array(fp)], [ROW, "doc_id", "fp"])

    return numbered(documents, "doc_id", "text").mapInArrow(run, f"{ROW} {KEY}, doc_id {documents.schema['doc_id'].dataType.simpleString()}, fp long")


def keys_of(fp, extra: int, radius: int) -> list:
    """The key columns: for each choice of 1 + extra of radius + 1 + extra blocks, the number of the choice and its bits."""
    n = radius + 1 + extra
    edges = [round(i * BITS / n) for i in range(n + 1)]
    out = []
    for number, chosen in enumerate(combinations(range(n), 1 + extra)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        mask -= (mask >> 63) << 64
        out.append(F.struct(F.lit(number).alias("choice"), fp.bitwiseAND(F.lit(mask).cast("long")).alias("bits")))
    return out


def pivot_columns(fp) -> dict:
    """The fingerprint's distances to the references, packed."""
    signed = REFERENCES.view(np.int64).tolist()
    one = lambda i: F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(signed[i]))).cast("long"), 8 * (i % 8))
    return {f"pivots_{k}": sum((one(8 * k + i) for i in range(1, 8)), one(8 * k)) for k in range(PIVOTS // 8)}


def distances(columns: list[np.ndarray]) -> np.ndarray:
    """A row of distances for each fingerprint, from its packed columns."""
    return np.stack(columns, 1).astype("<i8").view(np.uint8).astype(np.int16)


def near_pairs(x: np.ndarray, i: np.ndarray, j: np.ndarray, table_: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j) those within the radius: the pivot table discards, the bits verify."""
    for p in range(0, table_.shape[1], 4):  # four coordinates at a time
        keep = (np.abs(table_[i, p : p + 4] - table_[j, p : p + 4]) <= radius).all(1)
        i, j = i[keep], j[keep]
        if not len(i):
            return i, j
    keep = np.bitwise_count(x[i] ^ x[j]) <= radius
    return i[keep], j[keep]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index that each of n nodes reaches by the links (i, j)."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            break
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root = root[root]
    return root


def tile_links(x: np.ndarray, table_: np.ndarray, group: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, least member reached) within each group of a run that is sorted by group; side: 0 to compare all, else parts 1 and 2 to compare across."""
    starts = np.nonzero(np.r_[True, group[1:] != group[:-1]])[0]
    size = np.diff(np.r_[starts, len(group)])
    end = np.repeat(starts + size, size)
    many, at = [], np.arange(len(x))
    few = np.repeat(size <= 64, size)
    step = 1
    i = at[few]
    while len(i := i[i + step < end[i]]):  # all pairs of the small groups, by their distance in the run
        many.append(near_pairs(x, i, i + step, table_, radius))
        step += 1
    for s, n in zip(starts[size > 64], size[size > 64], strict=True):
        for a in range(s, s + n, 256):
            rows = at[a : min(a + 256, s + n)]
            i, j = (v.ravel() for v in np.meshgrid(rows, at[a : s + n], indexing="ij"))
            ok = (i < j) & ((side[i] == 0) | (side[i] != side[j]))
            many.append(near_pairs(x, i[ok], j[ok], table_, radius))
    i, j = (np.concatenate([m[k] for m in many]) for k in (0, 1)) if many else (at[:0], at[:0])
    root = forest(len(x), i, j)
    linked = np.nonzero(root != at)[0]
    return linked, root[linked]


def links_of(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """a, b: links within the radius between the fingerprints of distinct(fp, pivots), enough of them to connect all that are linked."""
    pivots = [f"pivots_{k}" for k in range(PIVOTS // 8)]
    n = distinct.count()
    extra = 0
    while extra < 4 and (1 + extra) * BITS // (radius + 1 + extra) < np.log2(max(n, 2)) - 2:  # few unrelated rows share a key
        extra += 1
    keyed = distinct.select("fp", *pivots, F.explode(F.array(*keys_of(F.col("fp"), extra, radius))).alias("key")).select("fp", *pivots, "key.choice", "key.bits")
    keyed = stored(keyed, "keys")
    hot = keyed.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TILE)
    hot = stored(hot.select("choice", "bits", F.ceil(F.col("n") / TILE).cast("int").alias("parts")), "hot")
    if hot.isEmpty():
        tiled = keyed.withColumns({"a": F.lit(0), "b": F.lit(0), "side": F.lit(0)})
    else:
        joined = keyed.join(hot, ["choice", "bits"], "left")
        part = F.pmod(F.xxhash64("fp", F.lit("part")), F.coalesce("parts", F.lit(1))).cast("int")
        joined = joined.withColumn("mine", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
        tiled = joined.select("fp", *pivots, "choice", "bits", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), side.alias("side"))
    group = ("choice", "bits", "a", "b")
    tiled = tiled.repartition(*group).sortWithinPartitions(*group)

    def run(batches):
        held = None
        for batch in batches:
            rows = {k: batch.column(k).to_numpy() for k in ("fp", *pivots, *group, "side")}
            if held is not None:
                rows = {k: np.concatenate([held[k], v]) for k, v in rows.items()}
            last = np.nonzero(np.logical_or.reduce([v[1:] != v[:-1] for v in (rows[k] for k in group)]))[0]
            cut = last[-1] + 1 if len(last) else 0  # the last group may go on
            held = {k: v[cut:] for k, v in rows.items()}
            if cut:
                yield out({k: v[:cut] for k, v in rows.items()})
        if held is not None and len(held["fp"]):
            yield out(held)

    def out(rows):
        x = rows["fp"].view(np.uint64)
        changes = np.logical_or.reduce([np.r_[False, rows[k][1:] != rows[k][:-1]] for k in group])
        i, j = tile_links(x, distances([rows[k] for k in pivots]), np.cumsum(changes), rows["side"], radius)
        return pa.RecordBatch.from_arrays([pa.array(rows["fp"][i]), pa.array(rows["fp"][j])], ["a", "b"])

    return tiled.mapInArrow(run, "a long, b long")


def groups(documents: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """row, doc_id, fp, kept (struct of doc_id and row: the least of the group) for each row of documents(doc_id, text), which are settled."""
    made = stored(fingerprints(documents, words), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)
    distinct = stored(made.groupBy("fp").agg(F.min(first).alias("first")).withColumns(pivot_columns(F.col("fp"))), "distinct")
    found = components(links_of(distinct, radius))
    roots = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    roots = stored(roots, "roots")
    least = roots.groupBy("root").agg(F.min("first").alias("kept"), F.count(F.lit(1)).alias("n"))
    least = stored(least.where(F.col("n") > 1).select("root", "kept"), "least")
    by_fp = stored(roots.join(least, "root", "left").select("fp", F.coalesce("kept", "first").alias("kept")), "kept")
    return made.join(by_fp, "fp").select(ROW, "doc_id", "fp", "kept")


def near_duplicates(documents: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id for each row of documents(doc_id, text)."""
    return groups(settled(documents), words, radius).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("kept.doc_id").alias("component_id"))


def deduplicated(documents: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """The rows of documents without those whose group keeps another row."""
    documents = settled(documents)
    return without(documents, groups(documents, words, radius).where(F.col(ROW) != F.col(f"kept.{ROW}")).select(ROW))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op10_simhash_near_dedup": op10_simhash_near_dedup}
ORACLE_SQL: dict[str, str] = {}
