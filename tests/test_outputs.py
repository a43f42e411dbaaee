"""Kept page sets, decisions output by output, previews and summaries, merged selections, numbered rows."""

import random

import pytest
from helpers import document
from pyspark.sql import functions as F

from pagequery.api import PageQuery
from pagequery.errors import ConflictError, SelectionError
from pagequery.operators import previews
from pagequery.plans.parser import parse_argument
from pagequery.plans.reuse import PageSets, canonical
from pagequery.sources import sinks
from pagequery.sources.relations import numbered, read_dump, text_pages


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def stored_pages(spark, tmp_path):
    made = random.Random(3)
    text_pages(spark, [(d, i, " ".join(made.choice("abcd") for _ in range(2))) for d in ("x", "y", "z") for i in range(1, 12)]).repartition(2).write.parquet(f"{tmp_path}/pages")
    return spark.read.parquet(f"{tmp_path}/pages")


def test_canonical_forms():
    same = lambda *x: len({canonical(parse_argument(e).node) for e in x}) == 1
    assert same("contains:'a' & contains:'b'", "contains:'b' & contains:'a'", "(contains:'b' & contains:'a') & contains:'b'", "!!contains:'a' & contains:'b'")
    assert same("contains:'a' | (contains:'b' | 3)", "(3 | contains:'a') | contains:'b'")
    assert not same("contains:'a' & contains:'b'", "contains:'a' | contains:'b'")
    assert not same("contains:'a' to contains:'b'", "contains:'b' to contains:'a'")
    assert same("!(contains:'a' & 2)", "!(2 & contains:'a')") and not same("contains:'a'+1", "contains:'a'-1")


@pytest.mark.parametrize("each", [None, 4])
def test_kept_sets_equal_the_plan_and_are_read_again(spark, stored_pages, tmp_path, each):
    kept, query = PageSets(stored_pages, str(tmp_path / "kept"), each), PageQuery(stored_pages)
    for e in ("contains:'a' & !contains:'b'", "contains:'b' | contains:'a'", "contains:'a' to contains:'b'", "(contains:'c'+1 | last 2) & !contains:'a'", "odd & 2-7", "all"):
        assert rows_of(kept.where(e)) == rows_of(query.where(e))
    first = kept.where("contains:'a' & !contains:'b'").inputFiles()
    assert kept.where("!contains:'b' & !!contains:'a'").inputFiles() == first
    plan = kept.flags([canonical(parse_argument(x).node) for x in ("contains:'a'", "contains:'c'")])._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema", 1)[1]


def test_kept_sets_follow_the_files(spark, stored_pages, tmp_path):
    kept = PageSets(stored_pages, str(tmp_path / "kept"))
    before = rows_of(kept.where("contains:'a'"))
    text_pages(spark, [("new", 1, "a")]).write.mode("append").parquet(f"{tmp_path}/pages")
    again = PageSets(spark.read.parquet(f"{tmp_path}/pages"), str(tmp_path / "kept"))
    assert rows_of(again.where("contains:'a'")) == sorted([*before, ("new", 1)], key=repr)
    with pytest.raises(SelectionError, match="files"):
        PageSets(document(spark, ["a"])).where("all")


# --- outputs ----------------------------------------------------------------------------------------------------------


def names(spark, *x):
    return spark.createDataFrame([(n,) for n in x], "name string")


def test_decisions(spark):
    planned, have = names(spark, "a", "b", "a_1", "c"), names(spark, "A", "a_2", "c", "c_1", "c_3")
    of = lambda conflict: {r.name: (r.action, r.final_name) for r in sinks.decided(planned, have, conflict).collect()}
    assert of("rename") == {"a": ("rename", "a_3"), "b": ("create", "b"), "a_1": ("create", "a_1"), "c": ("rename", "c_2")}
    assert of("ask") == of("rename")
    assert of("skip")["a"] == ("skip", "a") and of("overwrite")["c"] == ("overwrite", "c")
    with pytest.raises(ValueError, match="unknown"):
        sinks.decided(planned, have, "guess")


def test_each_output_has_its_own_decision(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = lambda *x: spark.createDataFrame([(o, t) for o, t in x], "output string, text string")
    held = lambda: rows_of(spark.read.schema("text string, output string").parquet(path).select("output", "text"))
    sinks.write_outputs(rows(("01", "first"), ("02", "first")), path)
    assert held() == [("01", "first"), ("02", "first")]
    sinks.write_outputs(rows(("02", "second"), ("03", "second")), path, "skip")
    assert held() == [("01", "first"), ("02", "first"), ("03", "second")]
    sinks.write_outputs(rows(("02", "third"), ("04", "third")), path, "overwrite")
    assert held() == [("01", "first"), ("02", "third"), ("03", "second"), ("04", "third")]
    plan = {r.name: r.final_name for r in sinks.write_outputs(rows(("02", "fourth"), ("05", "fourth"), ("02_1", "fourth")), path, "rename").collect()}
    assert plan == {"02": "02_2", "05": "05", "02_1": "02_1"}
    with pytest.raises(ConflictError, match="01") as error:
        sinks.write_outputs(rows(("01", "fifth"), ("06", "fifth")), path)
    assert error.value.paths == [f"{path}/output=01"]
    assert [r[0] for r in held()] == ["01", "02", "02_1", "02_2", "03", "04", "05"]


def test_collisions_on_any_input(spark):
    df = spark.range(600, numPartitions=5).select(F.concat(F.lit("n"), (F.col("id") % 7).cast("string"), F.lit(".pdf")).alias("name")).repartition(4)
    made = [r.final_name for r in sinks.without_collisions(df).collect()]
    assert len(set(made)) == 600 and {"n0.pdf", "n0_copy_01.pdf"} <= set(made)


# --- previews ---------------------------------------------------------------------------------------------------------


def test_previews_and_summary(spark):
    values = spark.createDataFrame([("b1", "f1", "ACME", "5"), ("b1", "f2", None, "6"), ("b1", "f3", "No_Match", "7"), ("b2", "f4", "X", None)], "batch string, file string, company string, total string")
    made = previews.previews(values, "{company}-{total|none}_{range}", F.col("file"), F.lit("2-4"), names(spark, "acme-5_2-4.pdf"))
    got = {r.file: (r.name, r.would_conflict, r.final_name, r.problems) for r in made.collect()}
    assert got["f1"] == ("ACME-5_2-4.pdf", True, "ACME-5_2-4_1.pdf", [])
    assert got["f2"] == ("PREVIEW-COMPANY-6_2-4.pdf", False, "PREVIEW-COMPANY-6_2-4.pdf", ["company was not found"]) or got["f2"][0] == "PREVIEW_COMPANY-6_2-4.pdf"
    assert got["f4"][3] == ["total was not found"]
    summary = {r.batch: (r.n, r.failed, r.reasons, [x.order for x in r.first_failures]) for r in previews.batch_summary(made, "batch", "file").collect()}
    assert summary == {"b1": (3, 2, {"company was not found": 2}, ["f2", "f3"]), "b2": (1, 1, {"total was not found": 1}, ["f4"])}
    many = spark.range(500).select(F.lit("b").alias("batch"), F.format_string("f%03d", "id").alias("file"), F.array(F.lit("why")).alias("problems"))
    top = previews.batch_summary(many, "batch", "file").first()
    assert (top.n, top.failed, [x.order for x in top.first_failures]) == (500, 500, [f"f{i:03d}" for i in range(10)])
    assert previews.warnings_of(made).count() == 3


def test_selections_follow_one_another(spark):
    df = text_pages(spark, [(d, i, f"p{i}") for d, n in (("a", 3), ("b", 1)) for i in range(1, n + 1)])
    q = PageQuery(df)
    both = q.select("3,1-2").followed_by(q.select("last 1"))
    assert {(r.doc_id, r.group_ix): r.pages for r in both.groups().collect()} == {("a", 1): [3], ("a", 2): [1, 2], ("a", 3): [3], ("b", 1): [1]}
    assert q.analyze().count() == 4 and q.split_pages().count() == 3
    assert q.outputs(q.select("all")).count() == 4


@pytest.mark.parametrize("each", [1 << 18, 50, 7])
def test_numbered_rows_of_any_ids(spark, each):
    made = random.Random(9)
    ids = [-5 * 10**18, 5 * 10**18, *(made.randint(-(2**63), 2**63 - 1) for _ in range(300)), *range(100)]
    rows = [("hot" if i % 3 else "cold" if i % 2 else None, x) for i, x in enumerate(ids)]
    df = spark.createDataFrame(rows, "k string, x long").repartition(4)
    want = {}
    for k in {r[0] for r in rows}:
        want |= {(k, x): n for n, x in enumerate(sorted(x for j, x in rows if j == k), 1)}
    assert {(r.k, r.x): r.n for r in numbered(df, "k", "x", "n", each).collect()} == want


def test_dumps_are_read_again(spark, tmp_path):
    texts = ["plain", "", "ends\n", "\n", "\n\n", "=== d, page 9 ===\nnot a page", "a\n=== b\n\\=== c\n\\", "\\", "x\r\ny\u2028=== z", "é中😀", None, "=== ", "last\n=== "]
    pages = text_pages(spark, [("d, page 1", i, t) for i, t in enumerate(texts, 1)])
    want = [(i, t or "") for i, t in enumerate(texts, 1)]
    sinks.dump_text(pages.repartition(3), str(tmp_path / "dump"))
    assert [(r.page_no, r.text) for r in read_dump(spark, str(tmp_path / "dump")).orderBy("page_no").collect()] == want
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        split = read_dump(spark, str(tmp_path / "dump"))
        assert split.rdd.getNumPartitions() > 2 and [(r.page_no, r.text) for r in split.orderBy("page_no").collect()] == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    query = read_dump(spark, str(tmp_path / "dump"), stream=True).writeStream.format("memory").queryName("dumped").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.page_no, r.text) for r in spark.table("dumped").collect()) == want
