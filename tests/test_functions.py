import pytest
from helpers import document
from pyspark.sql import functions as F

from pagequery.functions import classify, names, text
from pagequery.functions.trimming import trim, trim_one, trim_warnings
from pagequery.operators import analysis, extract, layout
from pagequery.plans.compact import parse_legacy, parse_pattern
from pagequery.sources import sinks
from pagequery.sources.relations import text_pages


def value(spark, column, **columns):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in columns.items())) if columns else spark.range(1)
    return df.select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "content, kind, count, start, result",
    [
        ("CompanyNameACME", "ch", 11, True, "ACME"),
        ("CompanyNameACME", "ch", 4, False, "CompanyName"),
        ("OLD REF 2024 001 TEMP", "wd", 1, True, "REF 2024 001 TEMP"),
        ("OLD REF 2024 001 TEMP", "wd", 2, False, "OLD REF 2024"),
        ("Account123Extra", "nb", 1, False, "Account"),
        ("123Account456", "nb", 1, True, "Account456"),
        ("Ref-2024-001-TEMP", "nb", 1, False, "Ref-2024-"),
        ("Ref-2024-001-TEMP", "nb", 2, False, "Ref-"),
        ("Invoice 1,250.00 Total", "nb", 1, False, "Invoice "),
        ("NoNumbers", "nb", 1, True, ""),
        ("abc", "ch", 3, True, ""),
        ("a\nb\nc", "ln", 1, True, "b\nc"),
        ("a\nb\nc", "ln", 3, False, ""),
    ],
)
def test_o2_to_o6(spark, content, kind, count, start, result):
    assert value(spark, trim_one(F.col("t"), kind, count, start), t=content) == result


def test_o7_o8(spark):
    assert value(spark, trim(F.col("t"), [("wd", 1), ("ch", 4)], [("wd", 2)]), t="OLD REF 2024 001 TEMP DRAFT") == "2024 001"
    assert len(value(spark, trim_warnings(F.col("t"), [("ch", 3), ("wd", 1)]), t="abc")) == 2


def test_m_types(spark):
    for content, images, kind in (("", 0, "empty"), ("Short", 0, "empty"), ("x" * 100, 0, "text"), ("", 3, "image"), ("x" * 100, 2, "mixed"), ("x" * 10, 1, "image")):
        assert value(spark, classify.page_type(F.col("t"), F.col("i")), t=content, i=images) == kind
    assert value(spark, classify.page_type(F.col("t"), F.col("i").cast("int")), t=None, i=None) == "empty"


def test_m3_m4_sizes(spark):
    expected = {"<500KB": 512000, ">1MB": 1048576, ">=2MB": 2097152, "<=100KB": 102400, "=1MB": 1048576, "<1.5GB": 1610612736}
    assert {k: classify.parse_size(k)[1] for k in expected} == expected
    assert value(spark, classify.size_matches(F.col("s"), "=1MB"), s=1048576 + 50000) and not value(spark, classify.size_matches(F.col("s"), "=1MB"), s=1048576 + 60000)
    with pytest.raises(ValueError):
        classify.parse_size("1MB")


def test_o10_o11_names(spark):
    for t, result in {"ACME Corp & Co.": "ACME-Corp-Co", "$1,250.00": "1250-00", "INV-2024/001": "INV-2024-001", "  ": "unknown"}.items():
        assert value(spark, names.sanitize_filename(F.col("t")), t=t) == result
    assert value(spark, names.sanitize_content(F.col("t"), "date"), t="March 15, 2024") == "March-15-2024"
    assert value(spark, names.sanitize_content(F.col("t"), "number"), t="1 250.5 x") == "1-250.5"


def test_o15_o16_o32_templates(spark):
    v = {"company": F.lit("ACME-Corp"), "invoice": F.lit("INV-2024-001"), "amount": F.lit("1250-00")}
    text_ = "{company|Unknown}_{invoice}_{amount|NO-AMT}_pages{range}.pdf"
    assert value(spark, names.template_name(text_, v, F.lit("doc"), F.lit("01-03"))) == "ACME-Corp_INV-2024-001_1250-00_pages01-03.pdf"
    empty = {"company": F.lit(None).cast("string")}
    assert value(spark, names.smart_name("{company}", empty, F.lit("doc"), F.lit("01"))) == "doc_pages01.pdf"
    assert value(spark, names.fill_template("{company}-{x|y}", empty)) == "NO-COMPANY-y"


def test_o19_o20_o27(spark):
    assert value(spark, names.sanitize_description(F.lit("Test: File<>Name|With*Bad?Chars"))) == "Test_File_Name_With_Bad_Chars"
    assert value(spark, names.extraction_name(F.lit("doc"), F.lit("all"), "separate")) == "doc_pages.pdf"
    assert [value(spark, names.estimated_pages(F.lit(x))) for x in ("01-03", "01,03,07", "page05")] == [3, 3, 1]


def test_o24_o25_cells(spark):
    cells = {"a\tb\nc": "a b c", " 1 234 ": "1234", "$ 5": "$5", "x  y": "x y"}
    assert {k: value(spark, names.clean_cell(F.col("t")), t=k) for k in cells} == cells


def test_r1_r3_white_space(spark):
    odd = " a\x1cb  c\t"
    assert value(spark, text.words(F.col("t")), t=odd) == odd.split()
    assert value(spark, text.trim_ws(F.col("t")), t=odd) == odd.strip()


INVOICE = "Company: ACME Corporation\nInvoice Number: INV-2024-001\nDate: March 15, 2024\n\nDescription: Software License\nAmount: $1,250.00\nTax: $125.00\nTotal: $1,375.00\n\nThank you for your business!"


def extracted(spark, pattern, pages=(INVOICE,)):
    return extract.extract(document(spark, list(pages)), [parse_pattern(pattern)]).first()


def test_l_goldens(spark):
    assert extracted(spark, "Amount:r1nb1").selected == ["1,250.00"]
    assert extracted(spark, "Description:r1wd0").selected == ["Software License"]
    assert extracted(spark, "Total:r1nb1-").selected == ["1,375.00"]
    assert extracted(spark, "Invoice Number:r1wd1_^ch4").selected == ["2024-001"]
    assert extracted(spark, "Company:d1ln1").selected == ["Invoice Number: INV-2024-001"]
    assert extracted(spark, "Nothing:wd1").success is False


def test_d9_to_d12(spark):
    assert extracted(spark, "Date:r1wd4-").selected == ["March 15, 2024 Description:"]  # D9: flexible goes on
    assert extracted(spark, "Amount:r1nb1").n_matches == 1  # D10: the first match by default
    pages = ["a X 1", "b X 2", "c X 3"]
    assert extracted(spark, "X:r1nb1pg2", pages).selected == ["2"]  # D11
    assert extracted(spark, "X:r1nb1pg0mt-2", pages).selected == ["2", "3"]
    assert extracted(spark, "X:l1wd3_$ch1pg3", pages).selected == ["cX"]  # D12: _ first, then trimming


def found(text, keyword):
    return [m[1:] for m in extract.Page(text, extract.phrases_of((keyword,))).found()]


def test_l8_l9_find():
    text = "An INVOICE-number: 5\nthe in-voice num ber\n -- \nx Invoice, Number"
    assert found(text, "invoice") == [(0, 1, "INVOICE-number:"), (1, 1, "in-voice"), (3, 1, "Invoice,")]
    assert found(text, "Invoice Number") == [(3, 2, "Invoice, Number")]
    assert [m[:2] for m in found("a -- b", "--")] == [(0, 0), (0, 1), (0, 2)]  # no letter or digit: every word
    assert found("", "x") == [] == found("x", " ")


def test_l24_debug_and_sql(spark):
    from pagequery.sql import register

    row = extract.debug(document(spark, [INVOICE]), parse_pattern("Amount:r1nb1")).first()
    assert (row.line, row.word, row.target_line, row.target_word, row.extracted) == (5, 0, 5, 1, "1,250.00")
    register(spark, invoice_pages=document(spark, [INVOICE, "Total: 7"]))
    assert [r.extracted for r in spark.sql("SELECT m.extracted FROM invoice_pages p, LATERAL keyword_matches(p.text, 'Total:r1nb1') m").collect()] == ["1,375.00", "7"]
    nested = "(SELECT doc_id, array_sort(collect_list(struct(page_no, text))) AS d FROM invoice_pages GROUP BY doc_id)"
    assert [tuple(r) for r in spark.sql(f"SELECT s.* FROM {nested} t, LATERAL text_fields(t.d, 'Total:r1nb1pg0mt-1') s").collect()] == [("total", 2, "7")]


def test_l17_variables(spark):
    df = extract.variables(document(spark, [INVOICE]), [parse_pattern("Amount:r1nb1"), parse_pattern("x=Nothing:wd1")])
    assert df.first().asDict() == {"doc_id": "d", "amount": "1,250.00", "x": "No_Match"}


@pytest.mark.parametrize(
    "page, pattern, result",
    [
        ("Invoice Number: 12345 ABC", "Invoice Number:right:0:word", "12345"),
        ("ABC 12345 Total Amount", "Total:left:1:word", "12345"),
        ("Header\nTotal: $100.50", "Header:below:1:line", "Total: $100.50"),
        ("Company Name Inc\nHeader", "Header:above:1:line", "Company Name Inc"),
        ("Amount is about 5 or 6", "Amount:right:0:number", "5"),
        ("Amount a b c 7", "Amount:right:0:number", None),
        ("Total", "Total:right:0:word", None),
        ("x\n\nTotal", "Total:above:1:line", None),
        ("A Total of 3 things", "total:right:0:text", "of 3 things"),
    ],
)
def test_l19_to_l21(spark, page, pattern, result):
    assert value(spark, extract.legacy_value(F.col("t"), parse_legacy(pattern)), t=page) == result


def test_l23_l25(spark):
    df = document(spark, ["Total: 5", "nothing", ""])
    assert [tuple(r) for r in extract.scrape(df, {"t": parse_legacy("Total:right:0:word"), "u": parse_legacy("No:right:0:word")}).collect()] == [("d", 1, "5", "")]
    assert value(spark, extract.legacy_debug(F.lit("Total 5"), parse_legacy("Total:right:0:word"))).keyword_found


def chars(spark, *placed):
    return spark.createDataFrame([("d", 1, t, float(x), float(x + 5), float(y)) for t, x, y in placed], "doc_id string, page_no int, text string, x0 double, x1 double, y1 double")


def test_k_layout(spark):
    row = [(c, 5 * i, 100) for i, c in enumerate("abc")] + [("d", 25, 99)]
    assert layout.page_texts(chars(spark, *row)).first().text == "abc\td"  # a far character becomes a new cell
    narrow = [("a", 0, 100), (" ", 2, 100), ("b", 5, 100), ("c", 10, 100), ("z", 0, 50)]
    assert layout.page_texts(chars(spark, *narrow)).first().text == "abc\nz"  # a space that is too narrow goes
    assert layout.page_texts(chars(spark, *row), fixed_keep=6.0).first().text == "abc d"
    # the anchor is the line's first character: heights may not creep
    creeping = [("a", 0, 100), ("b", 5, 98.5), ("c", 10, 97)]
    assert layout.page_texts(chars(spark, *creeping)).first().text == "ab\nc"


def test_j_analysis(spark):
    df = text_pages(spark, [("d", 1, "x" * 100, 2, 60 * 1024), ("d", 2, "", 0, 10), ("e", 1, "y", 5, 2 * 1048576)])
    assert {(r.doc_id, r.page_type): r.percent for r in analysis.type_distribution(df).collect()} == {("d", "mixed"): 50.0, ("d", "empty"): 50.0, ("e", "image"): 100.0}
    assert {r.doc_id for r in analysis.large_documents(df).collect()} == {"e"}
    assert {r.doc_id for r in analysis.malformed(df).collect()} == {"d", "e"}
    assert analysis.summary(df).where("doc_id = 'd'").first().average_size == (60 * 1024 + 10) // 2
    stats = analysis.table_stats(spark.createDataFrame([("a", ""), (None, "b")], "x string, y string")).first()
    assert (stats.rows, stats.empty_cells, stats.filled_cells, stats.fill_rate) == (2, 2, 2, 0.5)
    warned = analysis.warning_counts(spark.createDataFrame([("Xref broken",), ("other",)], "message string"), {"xref": "xref"})
    assert {r.kind: r.n for r in warned.collect()} == {"xref": 1, "other": 1}


def test_p_sinks(spark, tmp_path):
    from pagequery.errors import ConflictError

    df = document(spark, ["a", "b", "c"])
    from pagequery.api import PageQuery

    rows = PageQuery(df).select("3,1-2").rows
    out = str(tmp_path / "out")
    made = {tuple(r) for r in sinks.write_outputs(sinks.outputs(rows, df, "grouped"), out).collect()}
    assert made == {("d_group01", "create", "d_group01"), ("d_group02", "create", "d_group02")}
    assert spark.read.parquet(out).where("output = 'd_group01'").first().page_no == 3
    with pytest.raises(ConflictError):
        sinks.write_outputs(sinks.outputs(rows, df, "grouped"), out)
    sinks.write_tsv(spark.createDataFrame([("a\tb", "1 0")], "x string, y string"), str(tmp_path / "t"))
    assert "a b\t10" in "".join(p.read_text() for p in (tmp_path / "t").glob("part*"))
    assert sinks.copy_name("a.pdf", {"a.pdf", "a_copy_01.pdf"}.__contains__) == "a_copy_02.pdf" and sinks.unique_name("a.pdf", {"a.pdf"}.__contains__) == "a_1.pdf"
    planned, have = (spark.createDataFrame([(x,) for x in v], "name string") for v in (["A.pdf", "b.pdf"], ["a.pdf"]))
    assert [tuple(r) for r in sinks.conflicts(planned, have).collect()] == [("A.pdf", "a.pdf", False)]
    assert {tuple(r) for r in sinks.plan_operations(planned, have, "skip").collect()} == {("A.pdf", "skip"), ("b.pdf", "create")}
    assert sinks.validate_table(df) == [] and sinks.free_basename(["a.pdf"], "x") == "x" and sinks.free_basename(["X.pdf"], "x") == "x_1"
    sinks.dump_text(df, str(tmp_path / "dump"))
    assert sinks.preview_table(df.select("text"), 2).count() == 2


def test_a_sources(spark, tmp_path):
    from pagequery.sources import files

    (tmp_path / "b.pdf").write_bytes(b"%PDF-")
    (tmp_path / "A.PDF").write_bytes(b"%PDF-")
    (tmp_path / ".hidden.pdf").write_bytes(b"x")
    (tmp_path / "c.txt").write_bytes(b"x")
    assert {r.name for r in files.scan_folder(spark, str(tmp_path)).collect()} == {"b.pdf", "A.PDF"}
    assert files.scan_file(spark, str(tmp_path / "b.pdf")).count() == 1
    with pytest.raises(ValueError):
        files.scan_file(spark, str(tmp_path / "c.txt"))
    assert files.expand_paths([str(tmp_path / "*")]) == sorted(str(tmp_path / x) for x in ("A.PDF", "b.pdf"))


def test_streaming(spark, tmp_path):
    from pagequery.errors import SelectionError
    from pagequery.sources.relations import PAGE_SCHEMA
    from pagequery.streaming.pages import classify_stream, select_stream

    document(spark, ["the a", "b", "the c"]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(PAGE_SCHEMA).parquet(str(tmp_path / "in"))
    q = select_stream(stream, "contains:'the' & !1").writeStream.format("memory").queryName("picked").start()
    q.processAllAvailable()
    q.stop()
    assert [r.page_no for r in spark.table("picked").collect()] == [3]
    assert "page_type" in classify_stream(stream).columns
    with pytest.raises(SelectionError):
        select_stream(stream, "contains:'the' to contains:'c'")
