import pytest

from pagequery.errors import PatternError, SelectionError
from pagequery.plans import ast, lexer, parser, template
from pagequery.plans.compact import Pick, as_compact, parse_legacy, parse_pattern, parse_patterns, parse_pick, read_legacy_file
from pagequery.plans.trimmers import parse_trimmers


@pytest.mark.parametrize(
    "text, parts",
    [("a, b, c", ["a", "b", "c"]), ('contains:"north, south",type:text', ['contains:"north, south"', "type:text"]), ("a,'b,c',d", ["a", "'b,c'", "d"]), ("", [""]), (",", ["", ""]), ("a,", ["a", ""]), (r"a\,b,c", [r"a\,b", "c"])],
)
def test_f1_commas(text, parts):
    assert lexer.split_commas(text) == parts


@pytest.mark.parametrize("text, yes", [("contains:'Chapter 1' to contains:'Chapter 2'", True), ("5 to contains:'End'", True), ("type:text to type:empty", True), ("contains:'Go to the store'", False), ("5-10", False), ("all", False)])
def test_e1_ranges_are_seen(text, yes):
    assert lexer.is_range(text) is yes


@pytest.mark.parametrize(
    "text, yes",
    [("type:text & size:<500KB", True), ("!type:empty", True), ("(type:text)", True), ("contains:'a & b'", False), ("contains:'a | (b)'", False), ("type:text&size:<500KB", False), ("type:text|type:mixed", False), ("type:text  &  type:mixed", False), ("contains:Hello!", False)],
)
def test_d_det_booleans_are_seen(text, yes):
    assert lexer.is_boolean(text) is yes


def test_d_prec():
    a, b, c = (ast.Match("contains", x) for x in "ABC")
    assert parser.parse_boolean("contains:A | contains:B & !contains:C") == ast.Or(a, ast.And(b, ast.Not(c)))
    assert parser.parse_boolean("(contains:A | contains:B) & contains:C") == ast.And(ast.Or(a, b), c)
    assert parser.parse_boolean("contains:A & contains:B & contains:C") == ast.And(ast.And(a, b), c)
    assert parser.parse_boolean("!!contains:A") == ast.Not(ast.Not(a))


@pytest.mark.parametrize("text", ["contains:A & & contains:B", "(contains:A", "contains:A)", "() | 3", "! & 3", "!"])
def test_d_bal_errors(text):
    with pytest.raises(SelectionError):
        parser.parse_argument(text)


def test_d17_offsets():
    assert parser.parse_pattern("contains:'Covid-19'") == ast.Match("contains", "Covid-19")
    assert parser.parse_pattern("contains:'a'+2") == ast.Shift(ast.Match("contains", "a"), 2)
    with pytest.warns(UserWarning):
        assert parser.parse_pattern("contains:Covid-19") == ast.Shift(ast.Match("contains", "Covid"), -19)


def test_d18_escapes_stay():
    assert parser.parse_pattern(r"contains:'it\'s'") == ast.Match("contains", r"it\'s")


def test_c8_c9_prefixes():
    assert parser.is_pattern("Contains/i:x") and not parser.is_pattern("contains:") and not parser.is_pattern("contains:''") and not parser.is_pattern("other:x")
    assert parser.parse_pattern("REGEX/i:'a b'") == ast.Match("regex", "a b", True)


def test_f2_outer_quotes_and_f5_order():
    assert parser.parse('"1,3"') == parser.parse("1,3")
    assert parser.parse("10,5,15,2").preserve_order and parser.parse("5,contains:x").preserve_order and not parser.parse("1,3-5,odd").preserve_order


def test_b9_step_of_zero():
    with pytest.raises(SelectionError):
        parser.parse_argument("::0")


def test_h2_h7_filters():
    for ok in ("1,2,3", "1-3,5", "contains:'test'", "type:text & !type:empty", ""):
        assert parser.validate_filter(ok)[0], ok
    for bad in ("1,", "3-1", "0,1,2", "contains:'x", "& type:text", "type:text &", "(("):
        assert not parser.validate_filter(bad)[0], bad


def test_a10_a11_a12_selector_files(tmp_path):
    (tmp_path / "a.txt").write_text("# all\n1-5\n\n10,15,20   # some\n30-25\nnonsense here\n")
    with pytest.warns(UserWarning):
        assert parser.read_selector_file("a.txt", str(tmp_path)) == ["1-5", "10,15,20", "30-25"]
    with pytest.warns(UserWarning):
        assert [a.spec for a in parser.parse("file:a.txt,2", str(tmp_path)).arguments] == ["1-5", "10", "15", "20", "30-25", "2"]
    (tmp_path / "b.txt").write_text("# nothing\n")
    with pytest.raises(SelectionError):
        parser.read_selector_file("b.txt", str(tmp_path))
    assert parser.strip_comment("contains:'Invoice #42'   # note") == "contains:'Invoice #42'"


@pytest.mark.parametrize("text", ["Invoice:r1wd1pg2-4mt3", "ref=Reference:u1r2wd2-pg1mt2", "Total:d1r1nb1-", "Amount:nb1-", "Co:wd1_^ch4$wd2pg0", "A:u1ln1", "A:l2ln0-", "A:d1l3wd2"])
def test_l1_l2_patterns(text):
    parse_pattern(text)


@pytest.mark.parametrize("text", ["Invoice:wd1pg", "Invoice:wd1mt", "Invoice:wd1pg2-1", "Invoice:u1d2wd1", "Invoice:l1r2wd1", "Invoice:r100wd1", "Invoice:u1r1u1wd1", "Invoice:wd", "Invoice:zz1", "Invoice", ":wd1", "2x=Invoice:wd1", "range=A:wd1", "A:wd1^", "A:wd1^ch0", "A:wd100", "A:wd1pg2x", "A:r1", "A:wd1$"])
def test_l3_l4_errors(text):
    with pytest.raises(PatternError):
        parse_pattern(text)


def test_l5_picks():
    assert [parse_pick(x).kind for x in ("2", "2-4", "3-", "-2", "0")] == ["single", "range", "from", "last", "all"]
    assert Pick("last", 2).bounds(5) == (4, 5)


def test_l1_names_l6_duplicates():
    assert parse_pattern("Invoice Number:r1wd1").variable == "invoice_number"
    with pytest.raises(PatternError):
        parse_patterns(["Total:wd1", "total=X:wd1"])


def test_l18_l26_legacy(tmp_path):
    p = parse_legacy("Invoice Number:right:0:word")
    assert (p.keyword, p.direction, p.distance, p.kind) == ("Invoice Number", "right", 0, "word")
    assert as_compact(p).moves == (("r", 0),)
    (tmp_path / "p").write_text("# x\nTotal:left:1:number\nbroken\n")
    assert read_legacy_file(str(tmp_path / "p")) is None


def test_o1_blocks():
    assert parse_trimmers("wd1ch2") == [("wd", 1), ("ch", 2)]
    for bad in ("ch0", "invalid", "ch5xy2", ""):
        with pytest.raises(PatternError):
            parse_trimmers(bad)


def test_o9_o12_variables():
    names = {"Delivery  Note_No.": "delivery_note_no", "VAT %": "vat", "7 Items": "var_7_items", "__": "unknown", "x" * 30: "x" * 25, "": "unknown"}
    assert {k: template.variable_name(k) for k in names} == names
    assert template.auto_variable_name("gross weight of parcels") == "gross_weight_of"
    assert template.variable_name("a" * 24 + " b") == "a" * 24 and template.variable_name("a" * 23 + " b") == "a" * 23 + "_b"
    assert template.validate_variable("company")[0] and not template.validate_variable("pages")[0] and not template.validate_variable("a b")[0]


def test_o13_o14_o17_templates():
    text = "{company|Unknown}_{invoice}_pages{range}.pdf"
    assert template.parse_template(text) == [("company", "Unknown"), ("invoice", None), ("range", None)]
    assert template.required_variables(text) == {"company", "invoice", "range"}
    assert template.missing_variables(text, set()) == ["invoice"]
    for bad in ("{a", "a}", "{{a}}", "x" * 201, ""):
        assert not template.validate_template(bad)[0]
    assert template.preview("{invoice}-{x|y}", {"x": ""}) == "INV-2024-001-y"
    assert template.default_template(["a"]) == "{a|NO-A}_pages{range}.pdf"


def test_o18_o22_o23_descriptions():
    assert template.describe(["5"], 10) == "pages5" and template.describe(["1-3", "odd"], 10) == "pages1-3, odd_pages"
    assert template.describe([f"contains:'{i}'" for i in range(5)], 9) == "5patterns_9pg" and template.describe([], 3) == "empty"
    assert template.describe(["file:lists/mine.txt", "even", "contains:'a' & odd", "4-6"], 8) == "mixed_4args_1files-1patterns_8pg"
    words = {"first 3": "first_pages", "last 2": "last_pages", "regex:'x+'": "regex_pattern", "contains:'four and twenty birds'": "contains_four_and_twe...", "odd & 3": "boolean_expr", "9-": "9-", "type:text": "type_text"}
    assert {k: template.describe([k], 9) for k in words} == words
    assert template.pattern_description("contains:'a long one'") == "pattern-match" and template.boolean_description("a & !b") == "a-and-not-b"
    assert template.query_description("all", "contains:a", "contains:b", "1-2", 3) == "all-bounded-filtered-3groups"


def test_o21_batches():
    scheme = template.batch_scheme(["/x/inv_01.pdf", "/x/inv_02.pdf"])
    assert scheme["common_prefix"] == "inv_0" and scheme["count"] == 2
