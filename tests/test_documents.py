"""Streams and table functions give the rows of the batch selection."""

import random

import pytest
from pyspark.sql import functions as F

from pagequery.api import PageQuery
from pagequery.operators import groups
from pagequery.plans.evaluate import Document, first_listings, holds, leaves
from pagequery.plans.parser import parse, parse_pattern
from pagequery.sources.relations import text_pages
from pagequery.sql import register
from pagequery.streaming.documents import selection_stream

EXPRESSIONS = ["all", "last 3", "contains:'a'+1,2", "contains:'b'-4", "contains:'a' to contains:'b'", "contains:'x'+1 to contains:'d'-1,last 1", "(contains:'a' to contains:'b') & !contains:'c' | last 2", "5-2,::3,first 2,3-,-2,odd", "contains:'a' to contains:'none'", "12", "!regex/i:'A.*b',type:empty,size:<3,line-starts:'c'"]
SCHEMA = "doc_id string, page_no int, text string, image_count int, size_bytes long, event_time timestamp, n_pages int"


def made_pages(seed=4):
    made = random.Random(seed)
    return [(doc, i, " ".join(made.choice("abcdx") for _ in range(made.randint(0, 3)))) for doc, n in (("ten", 10), ("thirty", 30), ("one", 1), ("seven", 7)) for i in range(1, n + 1)]


@pytest.fixture(scope="module")
def pages(spark):
    return text_pages(spark, made_pages()).cache()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("expression", EXPRESSIONS)
def test_a_document_by_itself_equals_the_plan(pages, expression):
    tree = parse(expression)
    of = leaves(a.node for a in tree.arguments)
    by_doc = {}
    for r in pages.collect():
        by_doc.setdefault(r.doc_id, {})[r.page_no] = [holds(m, r.text, r.image_count, r.size_bytes) for m in of]
    got = [(d, *row) for d, flags in by_doc.items() for row in Document(flags, of).rows(tree)]
    assert sorted(got, key=repr) == rows_of(PageQuery(pages).select(expression).rows)


@pytest.mark.parametrize(("start", "end"), [("contains:'a'", None), (None, "contains:'b'"), ("contains:'c'-1", "contains:'d'")])
def test_splits_and_duplicates_equal_the_plan(pages, start, end):
    q = PageQuery(pages).select("odd,all")
    of = leaves(parse_pattern(x) for x in (start, end) if x)
    got, first = [], []
    by_doc = {}
    for r in pages.collect():
        by_doc.setdefault(r.doc_id, {})[r.page_no] = [holds(m, r.text, r.image_count, r.size_bytes) for m in of]
    for d, flags in by_doc.items():
        one = Document(flags, of)
        rows = [*one.split(one.rows(parse("odd,all")), *(parse_pattern(x) if x else None for x in (start, end)))]
        got += [(d, *r) for r in rows]
        first += [(d, *r) for r in first_listings(rows)]
    split = q.split(start, end)
    assert sorted(got, key=repr) == rows_of(split.rows)
    assert sorted(first, key=repr) == rows_of(split.dedup().rows)


# --- streams ----------------------------------------------------------------------------------------------------------


def written(spark, folder, batches):
    """Files that a stream reads one by one, each with the rows of a batch: (doc_id, page_no, text, second, n_pages)."""
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(d, p, t, 0, len(t.encode()), s, n) for d, p, t, s, n in rows], SCHEMA.replace("event_time timestamp", "event_time long"))
        df.withColumn("event_time", F.timestamp_seconds("event_time")).coalesce(1).write.mode("append").parquet(f"{folder}/b{i:03d}")


def streamed(spark, folder, expression, out, **options):
    pages = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/b*").withWatermark("event_time", options.pop("delay", "10 seconds"))
    rows = selection_stream(pages, expression, wait=options.pop("wait", 60), **options)
    query = rows.writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").option("path", f"{out}/rows").trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    return spark.read.schema(rows.schema).parquet(f"{out}/rows"), query


@pytest.mark.parametrize("expression", ["contains:'a' to contains:'b',last 2", "contains:'b'-4"])
def test_any_order_of_batches_gives_the_batch_result(spark, pages, tmp_path, expression):
    rows = made_pages()
    totals = {d: max(p for e, p, _ in rows if e == d) for d, _, _ in rows}
    for seed in (1, 2):
        made = random.Random(seed)
        made.shuffle(rows)
        batches = [[(d, p, t, made.randint(100, 105), totals[d]) for d, p, t in rows[i : i + 12]] for i in range(0, len(rows), 12)]
        batches.append([(d, p, t, 105, totals[d]) for d, p, t in rows[:9]])  # pages that come again
        written(spark, tmp_path / f"in{seed}", batches)
        got, _ = streamed(spark, tmp_path / f"in{seed}", expression, tmp_path / f"out{seed}", n_pages=F.col("n_pages"))
        assert rows_of(got) == rows_of(PageQuery(pages).select(expression).rows)


def test_documents_close_by_the_watermark(spark, tmp_path):
    """Pages without a number of pages: closed by time, state dropped, later pages dropped."""
    batches = [[("d", 2, "b", 10, None), ("e", 1, "a", 12, None)], [("d", 1, "a", 20, None)], [("far", 1, "x", 500, None)], [("d", 3, "a", 21, None)], [("far", 2, "x", 900, None)], [("end", 1, "x", 5000, None)], [("end", 2, "x", 9000, None)]]
    written(spark, tmp_path / "in", batches)
    got, query = streamed(spark, tmp_path / "in", "contains:'a',last 1", tmp_path / "out")
    rows = rows_of(got.select("doc_id", "group_ix", "page_no"))
    assert [r for r in rows if r[0] == "d"] == [("d", 1, 1), ("d", 2, 2)]  # page 3 came behind the watermark
    assert [r for r in rows if r[0] == "e"] == [("e", 1, 1), ("e", 2, 1)]
    assert [r for r in rows if r[0] == "far"] == [("far", 2, 2)]
    kept = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert kept <= 2 * 4  # what is left is of the last document alone


def test_streams_split_and_deduplicate(spark, pages, tmp_path):
    rows = made_pages()
    totals = {d: max(p for e, p, _ in rows if e == d) for d, _, _ in rows}
    written(spark, tmp_path / "in", [[(d, p, t, 1, totals[d]) for d, p, t in rows[::2]], [(d, p, t, 1, totals[d]) for d, p, t in rows[1::2]]])
    got, _ = streamed(spark, tmp_path / "in", "odd,all", tmp_path / "out", n_pages=F.col("n_pages"), group_start="contains:'a'", dedup=True)
    assert rows_of(got) == rows_of(PageQuery(pages).select("odd,all").split("contains:'a'").dedup().rows)


# --- table functions --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("expression", EXPRESSIONS)
def test_page_select(spark, pages, expression):
    register(spark, some_pages=pages)
    got = spark.sql("SELECT * FROM page_select(TABLE(some_pages), '" + expression.replace("'", "\\'") + "')")
    assert rows_of(got) == rows_of(PageQuery(pages).select(expression).rows)


def test_page_select_options(spark, pages):
    register(spark, some_pages=pages)
    got = spark.sql("SELECT * FROM page_select(TABLE(some_pages), 'odd,all', group_start => \"contains:'a'\", dedup => true)")
    assert rows_of(got) == rows_of(PageQuery(pages).select("odd,all").split("contains:'a'").dedup().rows)
    by_query = spark.sql("SELECT * FROM page_select(TABLE(SELECT * FROM some_pages WHERE doc_id <> 'one'), 'last 1')")
    assert {r.doc_id for r in by_query.collect()} == {"ten", "thirty", "seven"}


@pytest.mark.parametrize("call", ["page_select(TABLE(some_pages), 'nothing:x')", "page_select(TABLE(SELECT doc_id FROM some_pages), 'all')", "page_select('x', 'all')", "text_values(TABLE(some_pages), 'no pattern')"])
def test_table_functions_refuse(spark, pages, call):
    register(spark, some_pages=pages)
    with pytest.raises(Exception, match="cannot read|lacks|TABLE|keyword"):
        spark.sql(f"SELECT * FROM {call}").collect()


def test_text_values(spark):
    df = text_pages(spark, [("d", 1, "Total: 5\nTotal: 6"), ("d", 2, "Total: 7"), ("d", 3, "no"), ("e", 1, ""), ("e", 2, "Total: 9")])
    register(spark, total_pages=df)
    call = lambda spec: rows_of(spark.sql(f"SELECT doc_id, page_no, value FROM text_values(TABLE(total_pages), 'Total:r1nb1{spec}')"))
    assert call("") == [("d", 1, "5")]
    assert call("pg0mt0") == [("d", 1, "5"), ("d", 1, "6"), ("d", 2, "7"), ("e", 2, "9")]
    assert call("pg-2mt-1") == [("d", 2, "7"), ("e", 2, "9")]


def test_groups_of_streams_can_be_nested(pages):
    """The stream's rows are a selection relation, which the other operators take."""
    got = groups.nested(PageQuery(pages).select("last 2").rows)
    assert set(got.columns) == {"doc_id", "group_ix", "pages", "spec", "is_range", "preserve_order"}
