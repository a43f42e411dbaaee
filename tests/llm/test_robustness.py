"""Row keys under a change of executors, and malformed records."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagequery.llm import common, decontaminate, katz, neighbours, packing, shingles, simhash, token_count, warc

DATA = "/root/testdata/sf0.01"


# --- keys -------------------------------------------------------------------------------------------------------------


@pytest.fixture
def splits(spark):
    """splits(n): scans are from now on split as n cores would have it, and into small parts."""
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def split(n, size):
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", n)
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")

    yield split
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """documents and embeddings in several files of several row groups, which scans split differently."""
    at = tmp_path_factory.mktemp("parts")
    for name, n in (("documents", 3), ("embeddings", 3)):
        spark.read.parquet(f"{DATA}/{name}.parquet").repartition(n, F.xxhash64(*spark.read.parquet(f"{DATA}/{name}.parquet").columns[:1])).write.option("parquet.block.size", 64 << 10).parquet(f"{at}/{name}.parquet")
    return at


def rows_of(df):
    return sorted((tuple(str(x) if not isinstance(x, float) else round(x, 9) for x in r) for r in df.collect()), key=repr)


CALLS = {
    "simhash": lambda spark, d: simhash.deduplicated(d).select("doc_id"),
    "shingles": lambda spark, d: shingles.deduplicated(d).select("doc_id"),
    "decontaminated": lambda spark, d: decontaminate.decontaminated(d, common.table(spark, DATA, "benchmark")).select("doc_id"),
    "katz": lambda spark, d: katz.score(d, block_tokens=5000),
    "pipeline": lambda spark, d: corpus_pipeline.STAGES[1][1](spark, corpus_pipeline.STAGES[0][1](spark, d, DATA), DATA).select("doc_id"),
}


@pytest.mark.parametrize("name", CALLS)
def test_a_change_of_executors_between_call_and_action(spark, parts, splits, name):
    docs = spark.read.parquet(f"{parts}/documents.parquet")
    splits(2, "128m")
    want = rows_of(CALLS[name](spark, docs))
    made = CALLS[name](spark, spark.read.parquet(f"{parts}/documents.parquet"))
    splits(16, "40k")
    got = rows_of(made)
    assert len(got) == len(want)
    assert [r[0] for r in got] == [r[0] for r in want]
    if name != "katz":
        assert got == want
    else:
        assert all(abs(float(x) - float(y)) < 1e-6 for g, w in zip(got, want, strict=True) for x, y in zip(g[2:], w[2:], strict=True))


def test_neighbours_under_a_change_of_executors(spark, parts, splits):
    splits(2, "128m")
    table = spark.read.parquet(f"{parts}/embeddings.parquet")
    want = rows_of(neighbours.nearest(table))
    made = neighbours.nearest(spark.read.parquet(f"{parts}/embeddings.parquet"))
    splits(16, "40k")
    assert rows_of(made) == want


def test_keys_name_rows_for_good(spark, parts, splits):
    table = common.settled(spark.read.parquet(f"{parts}/documents.parquet").where("doc_id > 10").select("text", "doc_id"))
    keys = common.numbered(table, "doc_id")
    splits(2, "128m")
    first = keys.rdd.getNumPartitions(), rows_of(keys)
    splits(16, "40k")
    again = common.numbered(table, "doc_id")
    assert again.rdd.getNumPartitions() > first[0] and rows_of(again) == first[1]
    assert keys.select(common.ROW).distinct().count() == keys.count()


def test_tables_that_are_no_parquet_scan_are_stored(spark, parts):
    table = spark.read.parquet(f"{parts}/documents.parquet")
    others = [table.union(table), table.withColumn("x", F.rand()), table.distinct(), spark.createDataFrame([(1, "a")], "doc_id long, text string"), table.withColumn("y", F.monotonically_increasing_id())]
    for df in others:
        made = common.settled(df)
        keys = common.numbered(made, "doc_id")
        assert made is not df and keys.select(common.ROW).distinct().count() == df.count()
    clash = table.withColumn("_metadata", F.lit(1)).withColumn(common.ROW, F.lit(2))
    assert common.without(common.settled(clash), common.numbered(common.settled(clash), "doc_id").where("doc_id % 2 = 0").select(common.ROW)).where("doc_id % 2 = 0").isEmpty()


# --- WARC -------------------------------------------------------------------------------------------------------------


def record(i, body, length=None, kind="response"):
    stated = "" if length == "" else f"Content-Length: {len(body) if length is None else length}\r\n"
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <r{i}>\r\n{stated}\r\n".encode() + body + b"\r\n\r\n"


A, B, C = (record(i, b"HTTP/1.1 200 OK\r\n\r\n" + x) for i, x in enumerate((b"one", b"two" * 1000, b"three")))


def states(data):
    return [(r.get("warc-record-id"), r["state"]) for r in warc.parsed(data)]


WHOLE = [(f"<r{i}>", "whole") for i in range(3)]
BROKEN = (None, "unreadable")


def test_op3_whole_files():
    for data in (A + B + C, gzip.compress(A + B + C), b"".join(map(gzip.compress, (A, B, C))), gzip.compress(A) + gzip.compress(B + C)):
        assert states(data) == WHOLE
    assert states(b"") == [] and states(b"no records\n") == []


@pytest.mark.parametrize("length", ["abc", "-5", "", "1e3", "５", "0x10"])
def test_op3_lengths_that_are_no_numbers(length):
    got = [*warc.parsed(A + record(1, b"H\r\n\r\nbody", length) + C)]
    assert [r["state"] for r in got] == ["whole", "no length", "whole"]
    assert got[1]["block"] == b"H\r\n\r\nbody"


def test_op3_compressed_data_that_breaks():
    z = [*map(gzip.compress, (A, B, C))]
    bad = bytearray(z[1])
    bad[20] ^= 0xFF
    bad[30] ^= 0x55
    assert states(z[0] + bytes(bad) + z[2])[0] == WHOLE[0]
    assert states(z[0] + bytes(bad) + z[2])[-1] == WHOLE[2]
    assert BROKEN in states(z[0] + bytes(bad) + z[2])
    assert states(b"".join(z)[:-12])[:2] == WHOLE[:2] and BROKEN in states(b"".join(z)[:-12])
    assert states(gzip.compress(A + B + C)[:-20])[:2] == WHOLE[:2]
    assert states(b"\x1f\x8b\x08") == [BROKEN] == states(b"\x1f\x8b\x08garbage")
    assert states(A + record(1, b"x", 10**9))[1] == ("<r1>", "short")


def test_op3_any_damage_ends():
    made = random.Random(3)
    for n in range(1500):
        data = bytearray(b"".join(map(gzip.compress, (A, B, C))) if n % 2 else A + B + C)
        for _ in range(made.randint(1, 30)):
            i = made.randrange(len(data))
            if made.random() < 0.3:
                del data[i : i + made.randint(1, 9)]
            else:
                data[i] = made.randrange(256)
        states(bytes(data))


HOSTILE = ["idna", "undefined", "unicode_escape", "raw_unicode_escape", "utf-7", "punycode", "rot13", "base64", "zlib", "mbcs", "utf-16", "utf-32", "hz", "iso-2022-jp", "gb18030", "no-such"]


def test_op3_hostile_charsets_in_spark(spark):
    bodies = [b"\\ud800 +2AA- &#xD800; caf\xe9 <b>x</b> \x1b$B~~\xff\xfe", b"", b"\x00\xd8\x00\xd8"]
    rows = [(f"<{cs}{i}>", "http://x.y", None, f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset={cs}", b, None, None) for cs in HOSTILE for i, b in enumerate(bodies)]
    made = warc.derivatives(spark.createDataFrame(rows, warc.SOURCE)).collect()
    assert len(made) == 2 * len(rows)
    for r in made:
        assert r.content_length == len(r.block.encode()) and r.block_digest == warc.digest(r.block.encode())
    named = {r.refers_to: r.block for r in made if r.record_type == "conversion"}
    assert named["<unicode_escape0>"] == named["<no-such0>"] == bodies[0].decode("utf-8", "replace").replace("&#xD800;", "�").replace("<b>x</b>", "x").replace("\x1b", "\x1b")


def test_op3_files_with_malformed_records_in_spark(spark, tmp_path):
    z = [*map(gzip.compress, (A, B, C))]
    files = {"a.warc": A + record(1, b"x\r\n\r\ny", "abc") + C, "b.warc.gz": b"".join(z)[:-12], "c.warc.gz": z[0] + b"\x1f\x8b\x08 broken " + z[2], "d.warc.gz": b"", "e.warc": A + record(9, b"", -3)}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    found = warc.responses_of_files(spark.read.format("binaryFile").load(str(tmp_path)))
    counts = {r["state"]: r["n"] for r in found.groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts["no length"] == 2 and counts["unreadable"] >= 2 and counts["whole"] == 7 - 1 + 0 or counts["whole"] == 7
    kept = warc.derivatives(found.where("state <> 'unreadable'"), keep=("state",))
    assert kept.count() == 2 * found.where("state <> 'unreadable'").count()


def test_op3_written_files_are_members_of_one_record(spark, tmp_path):
    big = "word " * 4_000_000  # above 16 MB, where a member's last byte is not zero
    rows = [("<1>", "http://x.y/é", "2024-01-01T00:00:00Z", None, b"<p>caf\xc3\xa9</p>", None, None), ("<2>", "http://x.y", None, None, big.encode(), None, None)]
    records = warc.derivatives(spark.createDataFrame(rows, warc.SOURCE).repartition(2))
    warc.written(records, str(tmp_path / "w"))
    back = []
    for f in sorted((tmp_path / "w").glob("part*")):
        data = f.read_bytes()
        found = [*warc.parsed(data)]
        assert found[0]["warc-type"] == "warcinfo" and gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        assert all(r["state"] == "whole" for r in found)
        at, n = 0, 0
        while at < len(data):  # each member by itself is one record
            one = warc.zlib.decompressobj(31)
            whole = one.decompress(data[at:])
            at = len(data) - len(one.unused_data)
            if whole:
                assert whole.startswith(b"WARC/1.1") and whole.endswith(b"\r\n\r\n")
                n += 1
        assert n == len(found)
        back += found[1:]
    assert sorted(r["warc-record-id"] for r in back) == sorted(r.record_id for r in records.collect())
    assert {r["block"] for r in back if r["warc-type"] == "conversion"} == {"café".encode(), big.strip().encode()}


# --- bounds -----------------------------------------------------------------------------------------------------------


def test_op2_states_and_edges_are_bounded():
    """A word longer than there is room for states, and fields that fill the edges, give the library's ids."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_count.tokenizer_path())
    made = random.Random(1)
    words = token_count.load(token_count.tokenizer_path())
    words.transducer.most = 40
    fields = token_count.Fields(words, edges=300, edge_bytes=4000)
    for _ in range(30):
        part = ["".join(made.choice("abcdetrs") for _ in range(made.choice([3, 9, 400]))) for _ in range(40)]
        codes = fields.read([x.encode() for x in part], len(part))
        assert fields.ids(codes).tolist() == [i for x in part for i in library.encode(x, add_special_tokens=False).ids]
        assert len(words.transducer.states) <= 40 + 2
    assert fields.store.n < 1200 and fields.held < 40_000
    counting = token_count.load(token_count.tokenizer_path(), False)
    counting.transducer.most = 25
    word = "".join(made.choice("abcdetrs") for _ in range(5000))
    assert counting.transducer.count(word.encode()) == len(library.encode(word, add_special_tokens=False).ids)


def test_op5_every_step_counts():
    counts = dict.fromkeys((882, 997, 1201, 1350, 1502, 1666, 1801, 1994), 400)
    short, longer = (packing.bin_completion(counts, 4096, n) for n in (1, 500))
    assert not short.proven and short.sequences >= longer.sequences >= packing.lower_bound(counts, 4096)
    assert packing.bin_completion({7: 2, 5: 2, 3: 2}, 10, None).proven


def test_short_items_take_only_documents_that_are_the_item(spark):
    docs = spark.createDataFrame([(1, "yes it is"), (2, "Yes!"), (3, "no"), (4, "the answer is yes"), (5, None), (6, ""), (7, "a b c d e f g"), (8, "x a b c d e f g y")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Yes"), (2, "the answer"), (3, "A b c, d e f g"), (4, None), (5, "")], "item_id long, text string")
    kept = {r.doc_id for r in decontaminate.decontaminated(docs, items).collect()}
    assert kept == {1, 3, 4, 5, 6}
