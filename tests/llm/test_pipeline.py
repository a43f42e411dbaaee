import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from pagequery.llm import components, shingles, token_count

DATA = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("score", F.lit(1))
    docs = docs.unionByName(spark.createDataFrame([(9001, "12 34 !!"), (9002, None)], "doc_id long, text string"), allowMissingColumns=True)
    copy = docs.where("doc_id = 0").withColumn("doc_id", F.lit(9003).cast("long"))
    leak = spark.read.parquet(f"{DATA}/benchmark.parquet").limit(1).select(F.lit(9004).cast("long").alias("doc_id"), F.concat(F.lit("und das ist es: "), "text").alias("text"))
    docs = docs.unionByName(copy).unionByName(leak, allowMissingColumns=True)
    columns, kept = docs.columns, docs
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, DATA)
        assert kept.columns == columns, name
        seen.append({r.doc_id for r in kept.select("doc_id").collect()})
    assert {9001, 9002}.isdisjoint(seen[0]) and {9003, 9004} <= seen[0]
    assert 0 in seen[1] and 9003 not in seen[1] and 9004 in seen[1]
    assert 9004 not in seen[2] and seen[2] < seen[1]


def test_run_packs_what_is_kept(spark):
    rows = corpus_pipeline.run(spark, DATA).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    encode = token_count.load(token_count.tokenizer_path())
    for r in rows[:50]:
        ids = np.append(encode([texts[r.doc_id]])[0], np.array([1], "<u4"))
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 4096 and len(used) == -(-sum(used.values()) // 4096)


def jaccard_groups(rows):
    """The least doc_id that each document reaches by pairs of similarity 0.8 or more of their five-word shingles."""
    sets = {}
    for i, text in rows:
        w = (text or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return root


def test_near_copies_that_are_not_exact_go(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for base in range(60):
        text = list(rng.choice(words, int(rng.integers(20, 300))))
        rows.append((len(rows), " ".join(text)))
        for _ in range(int(rng.integers(0, 4))):  # some places changed: similarities on both sides of 0.8
            copy = list(text)
            for at in rng.choice(len(copy), int(rng.integers(1, 2 + len(copy) // 40)), replace=False):
                copy[at] = "changed"
            rows.append((len(rows), " ".join(copy)))
    line = "one line that stands in very many of the documents"
    rows += [(len(rows) + k, f"{line} {' '.join(rng.choice(words, 6))}") for k in range(50)] + [(5000, None), (5001, " "), (5002, "few words"), (5003, "Few  words")]
    root = jaccard_groups(rows)
    want = {i for i in root if root[i] == i}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(want) < len(rows) - 20
    for few, tile in ((32, 256), (1, 3)):
        monkeypatch.setattr(shingles, "FEW", few)
        monkeypatch.setattr(shingles, "TILE", tile)
        assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, DATA).collect()} == want


def test_pairs_of_a_group_of_near_copies_are_few(spark, monkeypatch):
    """A group of many parts, some of whose pairs are similar and some are not: no more than a few of each node are named."""
    rng = np.random.default_rng(7)
    rows = []
    for k in range(320):
        copy = [f"w{i}" for i in range(150)]
        for at in rng.choice(150, int(rng.integers(2, 4)), replace=False):
            copy[at] = f"c{k % 40}"
        rows.append((k, " ".join(copy)))
    want = {i for i, r in jaccard_groups(rows).items() if i == r}
    monkeypatch.setattr(shingles, "FEW", 4)
    monkeypatch.setattr(shingles, "TILE", 16)
    named, verified = [], shingles.verified
    monkeypatch.setattr(shingles, "verified", lambda pairs, *more: (named.append(pairs.count()), verified(pairs, *more))[1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, DATA).collect()} == want
    assert sum(named) < 8 * len(rows), named


def test_forests_connect_what_pairs_connect():
    rng = np.random.default_rng(8)
    for _ in range(30):
        n = int(rng.integers(2, 40))
        a, b = np.nonzero(np.triu(rng.random((n, n)) < 0.2, 1))
        far = rng.integers(0, 9, len(a))

        def parts(kept):
            root = list(range(n))
            for x, y in zip(a[kept].tolist(), b[kept].tolist(), strict=True):
                root = [root[y] if r == root[x] else r for r in root]
            return len(set(root))

        one = shingles.forests(a, b, far, 1)
        assert len(set(one.tolist())) == len(one) == n - parts(np.arange(len(a))) and parts(one) == parts(np.arange(len(a)))
        assert sorted(shingles.forests(a, b, far, 999).tolist()) == list(range(len(a)))


def test_pivots_bound_what_differs():
    rng = np.random.default_rng(4)
    for _ in range(50):
        shared, a, b = (rng.integers(-(2**63), 2**63 - 1, n) for n in (int(rng.integers(1, 400)), 9, 14))
        x, y = np.unique(np.concatenate([shared, a])), np.unique(np.concatenate([shared, b]))
        bits = np.stack([shingles.bit_map(v)[: shingles.MAP // 64] for v in (x, y)])
        apart = int(np.bitwise_count((bits[0] ^ bits[1]).view(np.uint64)).sum())
        table_ = shingles.pivot_table(bits).view("<u2").astype(int)
        assert np.abs(table_[0] - table_[1]).max() <= apart <= len(np.setxor1d(x, y))


def test_counts_bound_what_differs_in_large_sets():
    rng = np.random.default_rng(5)
    draw = lambda n: rng.integers(-(2**63), 2**63 - 1, n)
    shared = draw(6000)
    sets = [np.unique(np.concatenate([shared, draw(n)])) for n in (10, 500, 700)] + [draw(6500), draw(6500), draw(40)]
    maps = [shingles.bit_map(s) for s in sets]
    counts = shingles.counts_of(maps[:-1]).astype(int)
    for i, j in ((0, 1), (1, 2), (0, 3), (3, 4)):
        assert np.abs(counts[i] - counts[j]).sum() <= len(np.setxor1d(sets[i], sets[j]))
    pivots = shingles.pivot_table(np.stack([m[: shingles.MAP // 64] for m in maps]))
    size = np.array([len(s) for s in sets])
    near = lambda **more: set(zip(*(x.tolist() for x in shingles.hopeful(maps, pivots, size, np.zeros(6, int), 0.8, **more)), strict=True))
    assert near() == {(0, 1), (1, 0), (2, 0)}  # unrelated large sets are told apart
    assert near(most=9) == {(i, j) for i in range(3) for j in range(3) if i != j}
    apart = np.ones((6, 6), bool)
    apart[0, 1] = apart[1, 0] = False
    assert near(apart=apart) == {(0, 2), (1, 2), (2, 0)}


def test_large_near_copies(spark, monkeypatch):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(900)]
    passage = list(rng.choice(words, 120))
    rows = []
    for _ in range(12):
        text = [*passage, *rng.choice(words, int(rng.integers(300, 3000)))]
        rows.append((len(rows), " ".join(text)))
        for n in (2, 12, 70):
            copy = list(text)
            for at in rng.choice(len(copy), n, replace=False):
                copy[at] = "changed"
            rows.append((len(rows), " ".join(copy)))
    want = {i for i, r in jaccard_groups(rows).items() if i == r}
    assert 12 < len(want) < len(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for few, tile in ((32, 256), (1, 5)):
        monkeypatch.setattr(shingles, "FEW", few)
        monkeypatch.setattr(shingles, "TILE", tile)
        assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, DATA).collect()} == want


def test_run_on_odd_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int")
    rows = spark.read.parquet(f"{DATA}/documents.parquet").limit(20)
    odd = rows.unionByName(rows.limit(3)).unionByName(spark.createDataFrame([(None, None, None, None, None), (7001, "", "en", None, 0), (7002, "½ ²", None, "x", 3)], empty.schema), allowMissingColumns=True)
    for name, docs, items in (("none", empty, [(1, "a b c d e")]), ("no_items", odd, []), ("all", odd, [(1, None), (2, rows.first().text)])):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        ids = {r.doc_id for r in got}
        assert ids <= {r.doc_id for r in rows.collect()} and (name == "none") == (not got)
        if name == "all":
            assert rows.first().doc_id not in ids
        starts = [(r.doc_id, r.piece) for r in got]
        assert len(starts) == len(set(starts))  # repeated rows are near-duplicates of one another


def test_stages_begin_with_released_heaps(spark, monkeypatch):
    for name in ("identified", "deduplicated", "decontaminated", "pack"):
        monkeypatch.setattr(corpus_pipeline, name, lambda docs, *_: docs)
    beans = [b for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Young" not in b.getName() and "Concurrent" not in b.getName()]
    docs = spark.range(1)
    for name, stage in corpus_pipeline.STAGES:
        before = sum(b.getCollectionCount() for b in beans)
        assert stage(spark, docs, DATA) is docs
        assert sum(b.getCollectionCount() for b in beans) > before, name


def test_components_are_stored_in_few_files(spark, monkeypatch):
    """Each file that is written on a local file system starts processes beside the executor: their number does not follow the partitions of the shuffles."""
    seen, keep = [], components.stored
    monkeypatch.setattr(components, "stored", lambda df, label: (out := keep(df, label), seen.append(len(out.inputFiles())))[0])
    monkeypatch.setattr(shingles, "FILES", 1)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    rows = []
    for k in range(40):
        text = [f"w{k}_{i}" for i in range(100)]
        rows += [(3 * k + i, " ".join([*text, *["c"] * i])) for i in range(3)]
    want = {i for i, r in jaccard_groups(rows).items() if i == r}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "31")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {r.doc_id for r in shingles.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == want and len(want) == 40
    assert seen and max(seen) <= spark.sparkContext.defaultParallelism
