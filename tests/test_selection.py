import random
import warnings

import pytest
from helpers import FOUR, blank_pages, document, evaluate, section_ends

from pagequery.api import PageQuery
from pagequery.errors import SelectionError
from pagequery.operators import groups
from pagequery.plans import ast, parser
from pagequery.sources.relations import text_pages


def pages_of(selected):
    return [r.page_no for r in selected.pages("none").orderBy("out_ix").collect()]


def groups_of(selected):
    return [(r.group_ix, r.pages) for r in selected.groups().orderBy("group_ix").collect()]


@pytest.mark.parametrize(
    "expression, n, expected",
    [
        ("5", 10, [5]),
        ("3-7", 10, [3, 4, 5, 6, 7]),
        ("3:7", 10, [3, 4, 5, 6, 7]),
        ("3..7", 10, [3, 4, 5, 6, 7]),
        ("8-", 10, [8, 9, 10]),
        ("-3", 10, [1, 2, 3]),
        ("first 3", 10, [1, 2, 3]),
        ("first-3", 10, [1, 2, 3]),
        ("last 2", 10, [9, 10]),
        ("last-2", 10, [9, 10]),
        ("::2", 10, [1, 3, 5, 7, 9]),
        ("2::2", 10, [2, 4, 6, 8, 10]),
        ("1:6:2", 10, [1, 3, 5]),
        ("2:8:3", 10, [2, 5, 8]),
        ("5:10:1", 10, [5, 6, 7, 8, 9, 10]),
        ("10,5,15,2", 50, [10, 5, 15, 2]),
        ("3,1,4,1", 50, [3, 1, 4, 1]),
        ("10-7", 50, [10, 9, 8, 7]),
        ("20-15,10-5", 50, [20, 19, 18, 17, 16, 15, 10, 9, 8, 7, 6, 5]),
        ("1-5,10-6", 50, [1, 2, 3, 4, 5, 10, 9, 8, 7, 6]),
        ("all", 3, [1, 2, 3]),
    ],
)
def test_b_positions(spark, expression, n, expected):
    assert pages_of(PageQuery(blank_pages(spark, n)).select(expression)) == expected


def test_d20_strict_by_default(spark):
    q = PageQuery(blank_pages(spark, 50)).select("3,1,4,1")
    assert [r.page_no for r in q.pages().orderBy("out_ix").collect()] == [3, 1, 4]


def test_out_of_range_documents_are_skipped(spark):
    df = text_pages(spark, [("a", 1, "x"), ("a", 2, "x"), ("b", 1, "x")])
    assert {r.doc_id for r in PageQuery(df).select("all,2").rows.collect()} == {"a"}
    assert {(r.doc_id, r.page_no) for r in PageQuery(df, on_error="ignore").select("2,1").rows.collect()} == {("a", 2), ("a", 1), ("b", 1)}
    with pytest.raises(SelectionError):
        PageQuery(df, on_error="raise").select("2")


@pytest.mark.parametrize(
    "expression, expected",
    [("contains:'Chapter'", [1, 2]), ("!contains:'Chapter'", [3, 4]), ("contains/i:'CHAPTER'", [1, 2]), ("regex:'Ch\\w+ \\d'", [1, 2]), ("regex:'('", []), ("line-starts:'This'", [1, 2, 3]), ("type:text", [1]), ("contains:'Summary'-1", [2]), ("contains:'Chapter' & 2", [2]), ("all & !2-3", [1, 4]), ("(contains:'Chapter' to contains:'Summary') & !2", [1, 3])],
)
def test_c_d_predicates(spark, expression, expected):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert pages_of(PageQuery(document(spark, FOUR)).select(expression)) == expected


def test_e_sections_overlap(spark):
    texts = ["A", "x", "A", "B", "y", "A", "z", "B"]
    assert groups_of(PageQuery(document(spark, texts)).select("contains:'A' to contains:'B'")) == [(1, [1, 2, 3, 4]), (2, [3, 4]), (3, [6, 7, 8])]
    assert groups_of(PageQuery(document(spark, texts)).select("contains:'A' to 4")) == [(1, [1, 2, 3, 4]), (2, [3, 4])]
    assert groups_of(PageQuery(document(spark, texts)).select("contains:'B' to contains:'none',1")) == []  # no pair: the document is out


def test_empty_arguments_keep_their_number(spark):
    assert groups_of(PageQuery(document(spark, FOUR)).select("contains:'none',2")) == [(2, [2])]


def test_g_boundaries(spark):
    df = document(spark, ["", "s", "", "s", ""])
    assert groups_of(PageQuery(df).select("all").split(start="contains:'s'")) == [(1, [1]), (2, [2, 3]), (3, [4, 5])]
    assert groups_of(PageQuery(df).select("all").split(end="contains:'s'")) == [(1, [1, 2]), (2, [3, 4]), (3, [5])]
    assert groups_of(PageQuery(df).select("5-1").split("contains:'s'", "contains:'s'")) == [(1, [1]), (2, [2]), (3, [3]), (4, [4]), (5, [5])]


def test_h_filters(spark):
    df = document(spark, [f"p{i}" for i in range(1, 14)])
    q = PageQuery(df).select("1,2-4,5,7-10,12-13")
    assert [g for g, _ in groups_of(q.keep("1,3,5"))] == [1, 3, 5]
    assert [g for g, _ in groups_of(q.keep("2-4"))] == [2, 3, 4]
    assert [g for g, _ in groups_of(q.keep("1,10"))] == [1]
    assert [g for g, _ in groups_of(q.keep("contains:'p8' | contains:'p2'"))] == [2, 4]
    assert groups.describe_filter(q.rows, q.keep("1").rows) == "1 of 5 groups kept"
    with pytest.raises(SelectionError):
        q.keep("3-1")
    with pytest.warns(UserWarning):
        assert groups_of(q.keep("no such thing")) == []


def test_i_duplicates(spark):
    q = PageQuery(blank_pages(spark, 6)).select("1-3,2:4,4-6")
    assert {r.page_no for r in groups.duplicates(q.rows).collect()} == {2, 3, 4}
    assert groups_of(q.dedup("strict")) == [(1, [1, 2, 3]), (2, [4]), (3, [5, 6])]
    assert len(groups_of(q.dedup("groups"))) == 3 and q.dedup("none").rows.count() == 9
    with pytest.raises(SelectionError):
        q.dedup("fail")
    with pytest.warns(UserWarning):
        q.dedup("warn")


def test_j12_format(spark):
    for pages, text in (([1, 2, 3, 5, 7, 8, 9], "1-3, 5, 7-9"), ([10, 15, 20, 25], "10, 15, 20, 25")):
        df = spark.createDataFrame([("d", p) for p in pages], "doc_id string, page_no int")
        assert groups.format_ranges(df).first().ranges == text


LEAVES = ["contains:'a'", "contains:'b'", "regex:'c'", "line-starts:'a'", "odd", "2-3", "last 2", "first 1", "contains:'a'+1", "contains:'b'-2", "all"]


def random_tree(rng, depth=3):
    if depth == 0 or rng.random() < 0.2:
        return parser.parse_leaf(rng.choice(LEAVES))
    kind = rng.choice(["not", "and", "or", "section"])
    if kind == "not":
        return ast.Not(random_tree(rng, depth - 1))
    if kind == "section":
        return ast.Section(parser.parse_leaf(rng.choice(LEAVES)), parser.parse_leaf(rng.choice(LEAVES)))
    return {"and": ast.And, "or": ast.Or}[kind](random_tree(rng, depth - 1), random_tree(rng, depth - 1))


def test_random_trees_equal_the_plain_evaluator(spark):
    from pagequery.plans.compile import page_set

    rng = random.Random(7)
    docs = {f"d{k}": ["".join(rng.choice(["a", "b", "c", "\n", ""]) for _ in range(3)) for _ in range(rng.randint(1, 9))] for k in range(25)}
    df = text_pages(spark, [(d, i, t) for d, texts in docs.items() for i, t in enumerate(texts, 1)]).cache()
    for _ in range(12):
        node = random_tree(rng)
        got = {(r.doc_id, r.page_no) for r in page_set(df, node).collect()}
        assert got == {(d, p) for d, texts in docs.items() for p in evaluate(node, texts)}, node


def test_sections_are_minimal(spark):
    rng = random.Random(3)
    docs = {f"d{k}": [rng.choice(["a", "b", "ab", ""]) for _ in range(rng.randint(2, 9))] for k in range(20)}
    df = text_pages(spark, [(d, i, t) for d, texts in docs.items() for i, t in enumerate(texts, 1)])
    rows = PageQuery(df).select("contains:'a' to contains:'b'").groups().collect()
    node = parser.parse_range("contains:'a' to contains:'b'")
    assert {(r.doc_id, r.group_ix, r.pages[0], r.pages[-1]) for r in rows} == {(d, i, s, e) for d, texts in docs.items() for i, (s, e) in enumerate(section_ends(node, texts), 1)}


def test_page_filters_need_no_shuffle(spark):
    plan = PageQuery(document(spark, FOUR)).where("contains:'Chapter' & !type:empty")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    plan = PageQuery(document(spark, FOUR)).select("contains:'a'+1 to contains:'b',last 2").rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # all windows share the document


def test_d5_commas_come_first(spark):
    assert groups_of(PageQuery(document(spark, FOUR)).select("3,contains:'Chapter' & !2,last 1")) == [(1, [3]), (2, [1]), (3, [4])]


def test_d6_types_by_the_classifier(spark):
    df = document(spark, ["x" * 60, "x" * 60, "", "short"], images={2: 1, 3: 2})
    assert [pages_of(PageQuery(df).select(f"type:{t}")) for t in ("text", "mixed", "empty")] == [[1], [2], [4]]


def test_d19_bad_regex_matches_nothing(spark):
    with pytest.warns(UserWarning):
        assert pages_of(PageQuery(document(spark, FOUR)).select("regex:'('")) == []


def test_de_morgan_and_double_negation(spark):
    q = PageQuery(document(spark, FOUR))
    same = lambda a, b: {r.page_no for r in q.where(a).collect()} == {r.page_no for r in q.where(b).collect()}
    assert same("!(contains:'Chapter' & contains:'mixed')", "!contains:'Chapter' | !contains:'mixed'")
    assert same("!!contains:'Chapter'", "contains:'Chapter'")
