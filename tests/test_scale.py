"""Documents of any size, any number of arguments and of keywords: the same rows as by the plain way, with plans that do not grow."""

import random
import re

import pytest
from helpers import document
from pyspark.sql import Observation
from pyspark.sql import functions as F

from pagequery.api import TABLE_FROM, PageQuery
from pagequery.errors import SelectionError
from pagequery.functions.keywords import Automaton
from pagequery.operators import extract, groups
from pagequery.plans import arguments
from pagequery.plans.compact import parse_patterns
from pagequery.plans.parser import parse
from pagequery.sources.relations import text_pages

LETTERS = "abcdx"


@pytest.fixture(scope="module")
def pages(spark):
    """One long document, some short ones, and one of a single page."""
    made = random.Random(4)
    rows = [(doc, i, " ".join(made.choice(LETTERS) for _ in range(made.randint(0, 3)))) for doc, n in (("long", 157), ("ten", 10), ("eleven", 11), ("one", 1), ("blank", 5)) for i in range(1, n + 1)]
    return text_pages(spark, [(d, i, "" if d == "blank" else t) for d, i, t in rows]).repartition(3).cache()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


EXPRESSIONS = ["all", "last 3", "contains:'a'+1", "contains:'a'-2", "contains:'b'+13", "contains:'b'-40", "contains:'a' to contains:'b'", "contains:'x'+1 to contains:'d'-1", "(contains:'a' to contains:'b') & !contains:'c' | last 2", "contains:'a' to contains:'none'", "contains:'a',2-1,contains:'b' to contains:'c',last 4", "3,contains:'a' & contains:'b'"]


@pytest.mark.parametrize(("expression", "each"), [*((e, 3) for e in EXPRESSIONS), *((e, each) for e in EXPRESSIONS[-3:] for each in (1, 1000))])
def test_selections_by_ranges(pages, expression, each):
    plain, ranged = PageQuery(pages).select(expression), PageQuery(pages, range_pages=each).select(expression)
    assert rows_of(ranged.rows) == rows_of(plain.rows)
    if "," in expression:
        assert rows_of(ranged.pages()) == rows_of(plain.pages())


@pytest.mark.parametrize(("selection", "start", "end", "each"), [("all", "contains:'a'", None, 1), ("all", None, "contains:'b'", 10), ("odd", "contains:'a'", "contains:'b'", 4), ("9-1,all", "contains:'a'-1", "contains:'c'", 4), ("contains:'a' to contains:'b'", "contains:'c'", None, 4), ("all", "contains:'none'", None, 1000)])
def test_splits_by_ranges(pages, selection, start, end, each):
    plain, ranged = (PageQuery(pages, range_pages=e).select(selection).split(start, end) for e in (None, each))
    assert rows_of(ranged.rows) == rows_of(plain.rows)
    assert rows_of(ranged.keep("contains:'d'").rows) == rows_of(plain.keep("contains:'d'").rows)


@pytest.mark.parametrize("each", [1, 10])
@pytest.mark.parametrize("expression", ["all", "!contains:'a'", "odd", "contains:'none'"])
def test_runs_by_ranges(pages, expression, each):
    found = PageQuery(pages, on_error="ignore").where(expression)
    assert rows_of(groups.format_ranges(found, each)) == rows_of(groups.format_ranges(found))


def test_runs_of_random_sets(spark):
    made = random.Random(8)
    sets = {f"d{i}": sorted(made.sample(range(1, 60), made.randint(1, 58))) for i in range(60)}
    df = spark.createDataFrame([(d, p) for d, x in sets.items() for p in x], "doc_id string, page_no int")
    for each in (1, 3, 7):
        assert rows_of(groups.format_ranges(df, each)) == rows_of(groups.format_ranges(df))


def test_a_document_is_many_tasks(spark):
    """Pages are dealt out by document and range: no exchange of pages has the document as its only key."""
    n = 4000
    pages = spark.range(n, numPartitions=4).select(F.lit("d").alias("doc_id"), (F.col("id") + 1).cast("int").alias("page_no"), F.when(F.col("id") % 7 == 0, "a").when(F.col("id") % 11 == 0, "b").otherwise("").alias("text"), F.lit(0).alias("image_count"), F.lit(1).cast("long").alias("size_bytes"))
    rows = PageQuery(pages, range_pages=100).select("contains:'a'+1 to contains:'b',last 5").rows
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if " Window " in f" {x.strip(' :+-')} "]
    of_pages = [x for x in windows if "page_no" in x]
    assert of_pages and all("__range" in x.split("windowspec")[-1].split("[")[0] + x for x in of_pages)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = rows.groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks > 1
    for line in (x for x in plan.splitlines() if "partitionBy" in x):
        assert "text" not in line
    assert rows_of(rows) == rows_of(PageQuery(pages).select("contains:'a'+1 to contains:'b',last 5").rows)


# --- arguments --------------------------------------------------------------------------------------------------------


def test_bins_cover_their_span():
    made = random.Random(1)
    for _ in range(3000):
        low = made.randint(0, 10**6)
        high = min(arguments.OPEN, low + made.choice([0, 1, 2, 3, 7, 8, 9, 1000, arguments.OPEN]))
        level, bins = arguments.bins_of(low, high)
        assert 1 <= len(bins) <= 2 and 0 <= level <= 31
        for p in (low, high, (low + high) // 2):
            assert p >> level in bins


LISTS = ["1,2,3", "5-1,2-3,-4,3-,::2,2:5:2,first 2,last 2,all,odd,even", "contains:'a',contains:'b',contains/i:'A',contains:'zzz'", "contains:'a',1,!contains:'b',contains:'c'+1,last 1", "2,0", "11", "12-3,1", "regex:'a.b',type:empty,1-"]


@pytest.mark.parametrize("on_error", ["skip", "ignore"])
@pytest.mark.parametrize("expression", LISTS)
def test_argument_tables_equal_columns(pages, expression, on_error):
    from pagequery.plans import compile as plans

    tree = parse(expression)
    assert rows_of(arguments.select_table(pages, tree, on_error)) == rows_of(plans.select(pages, tree, on_error))
    assert rows_of(arguments.select_table(pages, tree, on_error, 4)) == rows_of(plans.select(pages, tree, on_error))


def test_argument_tables_raise(pages):
    with pytest.raises(SelectionError):
        arguments.select_table(pages, parse("1,2"), "raise").collect()
    with pytest.raises(SelectionError, match="sections"):
        arguments.select_table(pages, parse("contains:'a' to contains:'b'"))


def plan_size(df):
    return len(df._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_plans_do_not_grow_with_arguments(pages):
    sizes = []
    for n in (100, 3000):
        spans = ",".join(f"{i}-{i + i % 9}" for i in range(1, n + 1))
        rows = PageQuery(pages, on_error="ignore").select(spans).rows
        sizes.append(plan_size(rows))
        want = {("long", i, p) for i in range(1, n + 1) if i + i % 9 <= 157 for p in range(i, i + i % 9 + 1)}
        assert {(r.doc_id, r.group_ix, r.page_no) for r in rows.where("doc_id = 'long'").collect()} == want
    texts = [",".join(f"contains:'{'abcd'[i % 4]} {i}'" for i in range(n)) for n in (100, 3000)]
    sizes_of_texts = [plan_size(PageQuery(pages).select(x).rows) for x in texts]
    assert sizes[0] == sizes[1] and sizes_of_texts[0] == sizes_of_texts[1]
    assert TABLE_FROM < 100


def test_selector_files_of_any_length(pages, tmp_path):
    (tmp_path / "many.txt").write_text("\n".join(["# pages", *(f"{i}  # page {i}" for i in range(1, 151)), "contains:'a'"]))
    rows = PageQuery(pages, base_dir=str(tmp_path)).select("file:many.txt").rows
    assert {r.doc_id for r in rows.select("doc_id").distinct().collect()} == {"long"}
    assert rows.where("group_ix <= 150").count() == 150


def test_problems(pages):
    found = rows_of(PageQuery(pages).problems("2,contains:'a' to contains:'none',11,1-"))
    assert ("one", 1, "2", "page 2 of 1") in found
    assert {(r[0], r[1]) for r in found} == {("one", 1), ("one", 3), ("ten", 3), ("blank", 3), *((d, 2) for d in ("long", "ten", "eleven", "one", "blank"))}
    assert ("blank", 2, "contains:'a' to contains:'none'", "no start") in found
    assert rows_of(PageQuery(pages).problems("0")) == sorted((d, 1, "0", "page numbers begin at 1") for d in ("long", "ten", "eleven", "one", "blank"))
    assert PageQuery(pages).problems("all,contains:'a'").isEmpty()
    assert rows_of(PageQuery(pages, range_pages=4).problems("contains:'a' to contains:'b',99")) == rows_of(PageQuery(pages).problems("contains:'a' to contains:'b',99"))


def test_problems_are_counted_in_the_same_job(pages):
    seen = Observation()
    rows = PageQuery(pages).select("11,all", seen).rows.collect()
    assert {r.doc_id for r in rows} == {"long", "eleven"}
    assert seen.get == {"documents": 5, "invalid": 3}


# --- keywords ---------------------------------------------------------------------------------------------------------


def test_automaton_finds_what_in_finds():
    made = random.Random(2)
    for _ in range(300):
        words = list({"".join(made.choice("ab") for _ in range(made.randint(1, 5))) for _ in range(made.randint(1, 12))})
        text = "".join(made.choice("abc") for _ in range(made.randint(0, 30)))
        assert Automaton(words).found(text) == {i for i, w in enumerate(words) if w in text}


def expected_matches(text, keywords):
    """Each keyword by itself, word by word."""
    plain = lambda w: "".join(c for c in w.lower() if c.isalnum())
    out = []
    for k, keyword in enumerate(keywords):
        wanted = [plain(w) for w in keyword.split()]
        for i, line in enumerate(text.split("\n")):
            have = line.split()
            for j in range(len(have) - len(wanted) + 1) if wanted else ():
                if all(w in plain(h) for w, h in zip(wanted, have[j:], strict=False)):
                    out.append((k, i, j + len(wanted) - 1, " ".join(have[j : j + len(wanted)])))
    return sorted(out)


def test_phrases_equal_a_search_for_each():
    made = random.Random(5)
    word = lambda: "".join(made.choice("abAB-.1É") for _ in range(made.randint(1, 4)))
    for _ in range(200):
        keywords = [" ".join(word() for _ in range(made.randint(1, 3))) for _ in range(made.randint(1, 15))]
        text = "\n".join(" ".join(word() for _ in range(made.randint(0, 9))) for _ in range(made.randint(0, 5)))
        assert sorted(extract.Page(text, extract.phrases_of(tuple(keywords))).found()) == expected_matches(text, keywords)


def test_pages_without_a_keyword_are_not_read(spark):
    texts = ["An in-voice", "nothing here", "INVOICE", "invİoice", "Kelvin Kelvin", "i n v o i c e"]
    df = document(spark, texts)
    keep = extract.may_match(F.col("text"), ["invoice", "kelvin x"])
    kept = {r.text for r in df.where(keep).collect()}
    assert {"An in-voice", "INVOICE", "Kelvin Kelvin"} <= kept and "nothing here" not in kept and "i n v o i c e" not in kept
    assert extract.may_match(F.col("text"), ["é"]) is None and extract.may_match(F.col("text"), ["--"]) is None
    got = {r.page_no for r in extract.matches(df, parse_patterns(["a=invoice:wd1"])).collect()}
    assert got == {i for i, t in enumerate(texts, 1) if expected_matches(t, ["invoice"])}


def test_many_patterns_in_blocks(spark, monkeypatch):
    made = random.Random(6)
    texts = [" ".join("".join(made.choice("abc") for _ in range(4)) for _ in range(30)) for _ in range(12)]
    keywords = ["".join(x) for x in {tuple(made.choice("abc") for _ in range(3)) for _ in range(40)}]
    patterns = parse_patterns([f"v{i}={k}:r1wd1" for i, k in enumerate(keywords)])
    df = document(spark, texts)
    whole = rows_of(extract.matches(df, patterns))
    assert [(r[1], *r[2:6]) for r in whole] == sorted(((i, *m) for i, t in enumerate(texts, 1) for m in expected_matches(t, keywords)), key=repr)
    monkeypatch.setattr(extract, "BLOCK_CHARACTERS", 20)
    assert rows_of(extract.matches(df, patterns)) == whole


def test_plans_do_not_grow_with_patterns(spark):
    df = document(spark, ["x1 x2", "x3"])
    sizes = [plan_size(extract.extract(df, parse_patterns([f"v{i}=x{i}:wd1mt{1 + i % 2}" for i in range(n)]))) for n in (10, 2000)]
    assert sizes[0] == sizes[1]


def test_many_words(spark):
    texts = ["The cat\nscatter CATS", "", "dog", None]
    df = text_pages(spark, [("d", i, t) for i, t in enumerate(texts, 1)])
    got = rows_of(extract.legacy_matches_of(df, ["cat", "DOG", "at"]).select("page_no", "line", "word_index", "word", "keyword"))
    want = [(p, i, j, w, k) for p, t in enumerate(texts, 1) for i, line in enumerate((t or "").split("\n")) for j, w in enumerate(line.split()) for k in ("cat", "DOG", "at") if re.search(k, w, re.I)]
    assert got == sorted(want, key=repr)
    with pytest.raises(ValueError, match="single"):
        extract.legacy_matches_of(df, ["two words"])
