"""The engine's queries by name, and SQL that gives the same rows by another way.

Names start with the operator that a query shows. Every query runs over whole tables."""

from __future__ import annotations

import itertools
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequery.api import PageQuery
from pagequery.functions import names, text, trimming
from pagequery.functions.classify import format_size
from pagequery.operators import analysis, extract, groups, layout
from pagequery.sources import relations, sinks

from . import arguments
from .compact import parse_legacy, parse_patterns
from .compile import GROUP_COLUMNS
from .parser import parse
from .trimmers import parse_trimmers

FLAGSHIP = "d_and_not"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The page relations as SQL.
CONVERSATIONS = "p AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(turn + 1 AS INTEGER) AS page_no, coalesce(text, '') AS text, CAST(coalesce(length(text) % 3, 0) AS INTEGER) AS image_count, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size_bytes, role FROM conversations)"
SOURCES = "p AS (SELECT source AS doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS page_no, coalesce(text, '') AS text, CAST(0 AS INTEGER) AS image_count, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size_bytes FROM documents)"
COUNTED = "q AS (SELECT *, max(page_no) OVER (PARTITION BY doc_id) AS n FROM p)"
TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
TYPE = "(CASE WHEN length(" + TRIM.format("text") + ") >= 50 THEN CASE WHEN image_count > 0 THEN 'mixed' ELSE 'text' END WHEN image_count > 0 THEN 'image' ELSE 'empty' END)"


def query(name: str, build: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = build
    if sql:
        ORACLE_SQL[name] = sql


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def on_conversations(f: Callable[[DataFrame], DataFrame]):
    return lambda spark, sf_dir: f(relations.conversation_pages(spark, sf_dir))


def on_sources(f: Callable[[DataFrame], DataFrame]):
    return lambda spark, sf_dir: f(relations.source_pages(spark, sf_dir))


def quietly(f: Callable[[], DataFrame]) -> DataFrame:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return f()


def rows(pages: DataFrame, expression: str) -> DataFrame:
    return PageQuery(pages).select(expression).rows


# --- selectors: one argument, one group -------------------------------------------------------------------------------


def selector(name: str, expression: str, where: str, is_range: str = "count(*) OVER (PARTITION BY doc_id) > 1", pos: str = "page_no", more: str = "") -> None:
    """where may use n, the document's number of pages; is_range counts the rows that it leaves."""
    sql = f"WITH {CONVERSATIONS}, {COUNTED}{more} SELECT doc_id, CAST(1 AS INTEGER) AS group_ix, CAST({pos} AS INTEGER) AS pos, page_no, {quoted(expression)} AS spec, {is_range} AS is_range, false AS preserve_order FROM {'r' if more else 'q'} WHERE {where}"
    query(name, on_conversations(lambda p: rows(p, expression)), sql)


def page_filter(name: str, expression: str, where: str) -> None:
    """A set of pages by predicates alone: no shuffle."""
    query(name, on_conversations(lambda p: PageQuery(p).where(expression)), f"WITH {CONVERSATIONS}, {COUNTED} SELECT doc_id, page_no FROM q WHERE {where}")


selector("b1_all", "all", "true", "true")
selector("b2_odd", "odd", "page_no % 2 = 1", "false")
selector("b3_even", "even", "page_no % 2 = 0", "false")
selector("b4_page", "3", "n >= 3 AND page_no = 3", "false")
selector("b5_range", "2-4", "n >= 4 AND page_no BETWEEN 2 AND 4", "true")
selector("b6_reverse_range", "4-2", "n >= 4 AND page_no BETWEEN 2 AND 4", "true", "-page_no")
selector("b7_first", "first 2", "page_no <= 2", "true")
selector("b8_last", "last 2", "page_no > n - 2", "true")
selector("b9_every", "::3", "page_no % 3 = 1", "false")
selector("b10_step_from", "2::2", "n >= 2 AND page_no % 2 = 0", "false")
selector("b10_step_between", "2:5:2", "n >= 5 AND page_no IN (2, 4)", "false")
selector("b11_from", "3-", "n >= 3 AND page_no >= 3", "true")
selector("b11_until", "-3", "n >= 3 AND page_no <= 3", "true")
selector("b11_colon", "2:4", "n >= 4 AND page_no BETWEEN 2 AND 4", "true")

page_filter("c1_contains", "contains:'the'", "contains(text, 'the')")
page_filter("c2_contains_any_case", "contains/i:'THE'", "contains(lower(text), 'the')")
page_filter("c3_regex", "regex:'[aeiou]{3}n?t'", "regexp_matches(text, '[aeiou]{3}n?t')")
page_filter("c3_regex_any_case", "regex/i:'^th[aeiou]'", "regexp_matches(text, '(?i)^th[aeiou]')")
page_filter("c4_line_starts", "line-starts:'The'", "len(list_filter(string_split(text, chr(10)), lambda x: starts_with(ltrim(x), 'The'))) > 0")
page_filter("c4_line_starts_any_case", "line-starts/i:'an'", "len(list_filter(string_split(text, chr(10)), lambda x: starts_with(lower(ltrim(x)), 'an'))) > 0")
for kind in ("text", "image", "mixed", "empty"):
    page_filter(f"c5_type_{kind}", f"type:{kind}", f"{TYPE} = '{kind}'")
page_filter("c6_size_below", "size:<1KB", "size_bytes < 1024")
page_filter("c6_size_about", "size:=1KB", "abs(size_bytes - 1024) <= 1024")
page_filter("c6_size_from", "size:>=0.5KB", "size_bytes >= 512")
selector("c7_offset_after", "contains:'the'+1", "m", more=", r AS (SELECT *, coalesce(lag(contains(text, 'the'), 1) OVER (PARTITION BY doc_id ORDER BY page_no), false) AS m FROM q)", is_range="count(*) OVER (PARTITION BY doc_id) > 1")
selector("c7_offset_before", "contains:'the'-2", "m", more=", r AS (SELECT *, coalesce(lead(contains(text, 'the'), 2) OVER (PARTITION BY doc_id ORDER BY page_no), false) AS m FROM q)")
query("c13_pages_by_type", on_conversations(lambda p: analysis.analyze(p).where("page_type = 'text'").select("doc_id", "page_number")), f"WITH {CONVERSATIONS} SELECT doc_id, page_no AS page_number FROM p WHERE {TYPE} = 'text'")
query("c14_pages_by_size", on_conversations(lambda p: PageQuery(p).where("size:>200")), f"WITH {CONVERSATIONS} SELECT doc_id, page_no FROM p WHERE size_bytes > 200")

page_filter("d_and_not", "contains:'the' & !contains:'and'", "contains(text, 'the') AND NOT contains(text, 'and')")
page_filter("d_or", "contains:'und' | contains:'la'", "contains(text, 'und') OR contains(text, 'la')")
page_filter("d_not", "!contains:'the'", "NOT contains(text, 'the')")
page_filter("d_precedence", "contains:'la' | contains:'the' & !contains:'ing'", "contains(text, 'la') OR (contains(text, 'the') AND NOT contains(text, 'ing'))")
page_filter("d_parentheses", "(contains:'la' | contains:'the') & !contains:'ing'", "(contains(text, 'la') OR contains(text, 'the')) AND NOT contains(text, 'ing')")
page_filter("d1_all_in_boolean", "all & !type:empty", f"{TYPE} <> 'empty'")
page_filter("d1_numbers_in_boolean", "contains:'the' & !2-3 | last 1", "contains(text, 'the') AND page_no NOT BETWEEN 2 AND 3 OR page_no > n - 1")
selector("d_group", "contains:'the' & !contains:'and'", "contains(text, 'the') AND NOT contains(text, 'and')")

# --- sections: the nearest end at or after each start -----------------------------------------------------------------


def section_sql(start: str, end: str, relation: str = CONVERSATIONS) -> str:
    """s: the sections, by a correlated search."""
    return f"{relation}, {COUNTED}, f AS (SELECT doc_id, page_no, {start} AS a, {end} AS b FROM q), g AS (SELECT doc_id, page_no AS lo, (SELECT min(e.page_no) FROM f e WHERE e.doc_id = f.doc_id AND e.b AND e.page_no >= f.page_no) AS hi FROM f WHERE a), s AS (SELECT doc_id, lo, hi, row_number() OVER (PARTITION BY doc_id ORDER BY lo) AS i FROM g WHERE hi IS NOT NULL)"


def sections(name: str, expression: str, start: str, end: str) -> None:
    sql = f"WITH {section_sql(start, end)} SELECT doc_id, CAST(i AS INTEGER) AS group_ix, CAST(page_no AS INTEGER) AS pos, CAST(page_no AS INTEGER) AS page_no, {quoted(expression)} || ' (section ' || i || ')' AS spec, true AS is_range, false AS preserve_order FROM (SELECT doc_id, i, unnest(generate_series(lo, hi)) AS page_no FROM s)"
    query(name, on_conversations(lambda p: rows(p, expression)), sql)


sections("e3_sections", "contains:'the' to contains:'and'", "contains(text, 'the')", "contains(text, 'and')")
sections("e6_sections_offset", "contains:'ing'+1 to contains:'the'-1", "coalesce(lag(contains(text, 'ing')) OVER (PARTITION BY doc_id ORDER BY page_no), false)", "coalesce(lead(contains(text, 'the')) OVER (PARTITION BY doc_id ORDER BY page_no), false)")
sections("e7_sections_number", "2 to contains:'and'", "page_no = 2", "contains(text, 'and')")
query("e5_section_pages", on_conversations(lambda p: PageQuery(p).where("contains:'ing' to contains:'the'")), f"WITH {section_sql('contains(text, $$ing$$)', 'contains(text, $$the$$)')} SELECT DISTINCT doc_id, CAST(page_no AS INTEGER) AS page_no FROM (SELECT doc_id, unnest(generate_series(lo, hi)) AS page_no FROM s)")
query("e3_sections_long", on_sources(lambda p: groups.nested(rows(p, "contains:'License' to contains:'token'")).select("doc_id", "group_ix", F.get("pages", F.lit(0)).alias("first"), F.size("pages").alias("n"))), f"WITH {section_sql('contains(text, $$License$$)', 'contains(text, $$token$$)', SOURCES)} SELECT doc_id, CAST(i AS INTEGER) AS group_ix, CAST(lo AS INTEGER) AS first, CAST(hi - lo + 1 AS INTEGER) AS n FROM s")
query("d3_section_in_boolean", on_conversations(lambda p: PageQuery(p).where("(contains:'ing' to contains:'the') & !contains:'tion'")), f"WITH {section_sql('contains(text, $$ing$$)', 'contains(text, $$the$$)')}, u AS (SELECT DISTINCT doc_id, page_no FROM (SELECT doc_id, unnest(generate_series(lo, hi)) AS page_no FROM s)) SELECT u.doc_id, CAST(u.page_no AS INTEGER) AS page_no FROM u JOIN p ON p.doc_id = u.doc_id AND p.page_no = u.page_no WHERE NOT contains(text, 'tion')")

# --- lists, order, boundaries, filters, duplicates --------------------------------------------------------------------

LIST = "contains:'the',3-1,last 2"
LIST_SQL = f"{CONVERSATIONS}, {COUNTED}, l AS (SELECT doc_id, CAST(1 AS INTEGER) AS group_ix, page_no AS pos, page_no, $$contains:'the'$$ AS spec, count(*) OVER (PARTITION BY doc_id) > 1 AS is_range FROM q WHERE n >= 3 AND contains(text, 'the') UNION ALL SELECT doc_id, 2, -page_no, page_no, '3-1', true FROM q WHERE n >= 3 AND page_no <= 3 UNION ALL SELECT doc_id, 3, page_no, page_no, 'last 2', true FROM q WHERE n >= 3 AND page_no > n - 2)"
ROWS = "doc_id, group_ix, pos, page_no, spec, is_range, true AS preserve_order"
query("f3_list", on_conversations(lambda p: rows(p, LIST)), f"WITH {LIST_SQL} SELECT {ROWS} FROM l")
query("i2_dedup_strict", on_conversations(lambda p: groups.dedup(rows(p, LIST))), f"WITH {LIST_SQL} SELECT {ROWS} FROM l WHERE NOT EXISTS (SELECT 1 FROM l o WHERE o.doc_id = l.doc_id AND o.page_no = l.page_no AND o.group_ix < l.group_ix)")
query("i3_dedup_groups", on_conversations(lambda p: groups.dedup(rows(p, LIST), "groups")), f"WITH {LIST_SQL} SELECT {ROWS} FROM l")
query("i1_duplicates", on_conversations(lambda p: groups.duplicates(rows(p, LIST)).select("doc_id", "page_no", "n", F.array_join(F.transform("groups", lambda g: g["group_ix"].cast("string")), ",").alias("groups"))), f"WITH {LIST_SQL} SELECT doc_id, page_no, count(*) AS n, string_agg(CAST(group_ix AS VARCHAR), ',' ORDER BY group_ix) AS groups FROM l GROUP BY 1, 2 HAVING count(*) > 1")
query("f9_ordered_pages", on_conversations(lambda p: PageQuery(p).select(LIST).pages()), f"WITH {LIST_SQL}, d AS (SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM l o WHERE o.doc_id = l.doc_id AND o.page_no = l.page_no AND o.group_ix < l.group_ix)) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY group_ix, pos) AS INTEGER) AS out_ix, page_no FROM d")
query("f6_groups", on_conversations(lambda p: groups.nested(rows(p, LIST)).select("doc_id", "group_ix", F.array_join("pages", ",").alias("pages"), groups.consecutive(F.col("pages")).alias("consecutive"))), f"WITH {LIST_SQL} SELECT doc_id, group_ix, string_agg(CAST(page_no AS VARCHAR), ',' ORDER BY pos) AS pages, count(*) > 1 AND max(page_no) - min(page_no) + 1 = count(*) AS consecutive FROM l GROUP BY 1, 2")
query("f8_range_group", on_conversations(lambda p: relations.document_info(p).select("doc_id", F.array_join(groups.range_group(F.col("page_count"), F.lit(3)), ",").alias("pages"))), f"WITH {CONVERSATIONS}, d AS (SELECT doc_id, max(page_no) AS n FROM p GROUP BY 1), u AS (SELECT doc_id, unnest(generate_series(least(n, 3), greatest(n, 3))) AS x FROM d) SELECT doc_id, string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) AS pages FROM u GROUP BY 1")

query("i4_dedup_none", on_conversations(lambda p: groups.dedup(rows(p, LIST), "none")), f"WITH {LIST_SQL} SELECT {ROWS} FROM l")
query("i4_dedup_warn", on_conversations(lambda p: quietly(lambda: groups.dedup(rows(p, LIST), "warn"))), ORACLE_SQL["i2_dedup_strict"])
query("f6_ordered_group", on_conversations(lambda p: groups.nested(rows(p, LIST)).select("doc_id", "group_ix", groups.ordered_group(F.flatten(F.array("pages", "pages")), F.col("spec")).alias("g")).select("doc_id", "group_ix", F.array_join("g.pages", ",").alias("pages"), "g.is_range")), f"WITH {LIST_SQL}, a AS (SELECT doc_id, group_ix, list(page_no ORDER BY pos) AS ps FROM l GROUP BY 1, 2) SELECT doc_id, group_ix, CASE WHEN group_ix = 2 THEN array_to_string(list_concat(ps, ps), ',') ELSE array_to_string(list_sort(ps), ',') END AS pages, group_ix <> 2 AND len(ps) > 1 AND list_max(ps) - list_min(ps) + 1 = len(ps) AS is_range FROM a")
SPLIT_SQL = f"{CONVERSATIONS}, f AS (SELECT doc_id, page_no, contains(text, 'la') AS a, contains(text, 'and') AS b FROM p), g AS (SELECT *, CASE WHEN page_no = min(page_no) OVER (PARTITION BY doc_id) OR a OR coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY page_no), false) THEN 1 ELSE 0 END AS o FROM f), h AS (SELECT doc_id, page_no, CAST(sum(o) OVER (PARTITION BY doc_id ORDER BY page_no) AS INTEGER) AS group_ix FROM g)"
query("g2_split", on_conversations(lambda p: groups.split_at(rows(p, "all"), p, "contains:'la'", "contains:'and'")), f"WITH {SPLIT_SQL}, c AS (SELECT doc_id, group_ix, min(page_no) AS lo, max(page_no) AS hi FROM h GROUP BY 1, 2) SELECT h.doc_id, h.group_ix, page_no AS pos, page_no, CASE WHEN lo = hi THEN 'page' || lo ELSE 'pages' || lo || '-' || hi END AS spec, hi > lo AS is_range, false AS preserve_order FROM h JOIN c ON c.doc_id = h.doc_id AND c.group_ix = h.group_ix")
query("g3_split_list", on_conversations(lambda p: groups.nested(groups.split_at(rows(p, "odd"), p, "contains:'the'")).select("doc_id", "group_ix", "spec", "is_range")), f"WITH {CONVERSATIONS}, f AS (SELECT doc_id, page_no, contains(text, 'the') AS a FROM p WHERE page_no % 2 = 1), h AS (SELECT doc_id, page_no, CAST(sum(CASE WHEN page_no = 1 OR a THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_no) AS INTEGER) AS group_ix FROM f) SELECT doc_id, group_ix, CASE WHEN count(*) = 1 THEN 'page' || min(page_no) ELSE 'pages' || string_agg(CAST(page_no AS VARCHAR), ',' ORDER BY page_no) END AS spec, count(*) > 1 AS is_range FROM h GROUP BY 1, 2")
query("h3_keep_indices", on_conversations(lambda p: groups.keep_groups(rows(p, LIST), p, "1,3")), f"WITH {LIST_SQL} SELECT {ROWS} FROM l WHERE group_ix IN (1, 3)")
query("h4_keep_criteria", on_conversations(lambda p: groups.keep_groups(groups.split_at(rows(p, "all"), p, "contains:'la'", "contains:'and'"), p, "contains:'the' & !contains:'ing'").select("doc_id", "group_ix", "page_no")), f"WITH {SPLIT_SQL} SELECT doc_id, group_ix, page_no FROM h WHERE EXISTS (SELECT 1 FROM h o JOIN p ON p.doc_id = o.doc_id AND p.page_no = o.page_no WHERE o.doc_id = h.doc_id AND o.group_ix = h.group_ix AND contains(text, 'the') AND NOT contains(text, 'ing'))")
query("h9_preview", on_conversations(lambda p: groups.preview_filter(rows(p, LIST), p, "contains:'und'")), f"WITH {LIST_SQL} SELECT doc_id, group_ix, any_value(spec) AS spec, count(*) AS n_pages, CASE WHEN bool_or(EXISTS (SELECT 1 FROM p WHERE p.doc_id = l.doc_id AND p.page_no = l.page_no AND contains(p.text, 'und'))) THEN 'KEEP' ELSE 'SKIP' END AS status FROM l GROUP BY 1, 2")
query("h6_group_sizes", on_conversations(lambda p: groups.group_sizes(rows(p, LIST), p)), f"WITH {LIST_SQL} SELECT l.doc_id, group_ix, CAST(sum(size_bytes) AS BIGINT) AS size_bytes FROM l JOIN p ON p.doc_id = l.doc_id AND p.page_no = l.page_no GROUP BY 1, 2")
query("h5_overlap", on_conversations(lambda p: groups.nested(rows(p, LIST)).select("doc_id", "group_ix", groups.overlaps(F.col("pages"), F.array(F.lit(1), F.lit(4))).alias("overlaps"), groups.contains_all(F.col("pages"), F.array(F.lit(1), F.lit(2))).alias("contains_all"))), f"WITH {LIST_SQL} SELECT doc_id, group_ix, bool_or(page_no IN (1, 4)) AS overlaps, count(*) FILTER (WHERE page_no IN (1, 2)) = 2 AS contains_all FROM l GROUP BY 1, 2")
query("j12_ranges", on_conversations(lambda p: groups.format_ranges(PageQuery(p).where("contains:'the'"))), f"WITH {CONVERSATIONS}, i AS (SELECT doc_id, page_no, page_no - row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS k FROM p WHERE contains(text, 'the')), r AS (SELECT doc_id, min(page_no) AS a, max(page_no) AS b FROM i GROUP BY doc_id, k) SELECT doc_id, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ', ' ORDER BY a) AS ranges FROM r GROUP BY 1")
query("j13_unselected", on_conversations(lambda p: groups.unselected(p, rows(p, "contains:'the',last 1"))), f"WITH {CONVERSATIONS}, {COUNTED} SELECT doc_id, page_no FROM q WHERE NOT contains(text, 'the') AND page_no < n")
query("j14_estimate", on_conversations(lambda p: groups.output_estimates(p, rows(p, "first 2")).select("doc_id", F.round("size_mb", 9).alias("size_mb"))), f"WITH {CONVERSATIONS} SELECT doc_id, round(sum(size_bytes) / 1048576 * least(2, max(page_no)) / count(*), 9) AS size_mb FROM p GROUP BY 1")

# --- documents of any size: the same by ranges of pages, in two levels -------------------------------------------------

EACH = 50


def ranged(pages: DataFrame) -> PageQuery:
    return PageQuery(pages, range_pages=EACH)


LONG = f"{SOURCES}, {COUNTED}"
LONG_LIST = "contains:'token',9-1,last 20"
LONG_LIST_SQL = f"{LONG}, l AS (SELECT doc_id, 1 AS group_ix, page_no AS pos, page_no FROM q WHERE n >= 9 AND contains(text, 'token') UNION ALL SELECT doc_id, 2, -page_no, page_no FROM q WHERE n >= 9 AND page_no <= 9 UNION ALL SELECT doc_id, 3, page_no, page_no FROM q WHERE n >= 9 AND page_no > n - 20)"
LONG_SECTIONS = "contains:'License' to contains:'token'"
query("c7_offset_ranges", on_sources(lambda p: ranged(p).select("contains:'token'+3").rows), f"WITH {LONG}, r AS (SELECT *, coalesce(lag(contains(text, 'token'), 3) OVER (PARTITION BY doc_id ORDER BY page_no), false) AS m FROM q) SELECT doc_id, CAST(1 AS INTEGER) AS group_ix, page_no AS pos, page_no, $$contains:'token'+3$$ AS spec, count(*) OVER (PARTITION BY doc_id) > 1 AS is_range, false AS preserve_order FROM r WHERE m")
query("c7_offset_far_ranges", on_sources(lambda p: ranged(p).where("contains:'token'-70 | last 3")), f"WITH {LONG}, r AS (SELECT *, coalesce(lead(contains(text, 'token'), 70) OVER (PARTITION BY doc_id ORDER BY page_no), false) AS m FROM q) SELECT doc_id, page_no FROM r WHERE m OR page_no > n - 3")
query("e3_sections_ranges", on_sources(lambda p: groups.nested(ranged(p).select(LONG_SECTIONS).rows).select("doc_id", "group_ix", F.get("pages", F.lit(0)).alias("first"), F.size("pages").alias("n"))), ORACLE_SQL["e3_sections_long"])
query("e5_section_pages_ranges", on_sources(lambda p: ranged(p).where(LONG_SECTIONS)), f"WITH {section_sql('contains(text, $$License$$)', 'contains(text, $$token$$)', SOURCES)} SELECT DISTINCT doc_id, CAST(page_no AS INTEGER) AS page_no FROM (SELECT doc_id, unnest(generate_series(lo, hi)) AS page_no FROM s)")
LONG_SPLIT = f"{LONG}, f AS (SELECT doc_id, page_no, contains(text, 'License') AS a, contains(text, 'token') AS b FROM q WHERE page_no % 2 = 1), g AS (SELECT *, CASE WHEN a OR coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY page_no), true) THEN 1 ELSE 0 END AS o FROM f), h AS (SELECT doc_id, page_no, CAST(sum(o) OVER (PARTITION BY doc_id ORDER BY page_no) AS INTEGER) AS group_ix FROM g)"
query("g2_split_ranges", on_sources(lambda p: ranged(p).select("odd").split("contains:'License'", "contains:'token'").rows.select("doc_id", "group_ix", "page_no", "spec", "is_range")), f"WITH {LONG_SPLIT}, c AS (SELECT doc_id, group_ix, count(*) AS k, string_agg(CAST(page_no AS VARCHAR), ',' ORDER BY page_no) AS t FROM h GROUP BY 1, 2) SELECT h.doc_id, h.group_ix, page_no, CASE WHEN k = 1 THEN 'page' ELSE 'pages' END || t AS spec, k > 1 AS is_range FROM h JOIN c ON c.doc_id = h.doc_id AND c.group_ix = h.group_ix")
query("f9_ordered_pages_ranges", on_sources(lambda p: ranged(p).select(LONG_LIST).pages()), f"WITH {LONG_LIST_SQL}, d AS (SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM l o WHERE o.doc_id = l.doc_id AND o.page_no = l.page_no AND o.group_ix < l.group_ix)) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY group_ix, pos) AS INTEGER) AS out_ix, page_no FROM d")
query("j12_ranges_ranges", on_sources(lambda p: groups.format_ranges(ranged(p).where("!contains:'token'"), EACH)), f"WITH {SOURCES}, i AS (SELECT doc_id, page_no, page_no - row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS k FROM p WHERE NOT contains(text, 'token')), r AS (SELECT doc_id, min(page_no) AS a, max(page_no) AS b FROM i GROUP BY doc_id, k) SELECT doc_id, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ', ' ORDER BY a) AS ranges FROM r GROUP BY 1")
query("h4_keep_ranges", on_sources(lambda p: ranged(p).query("all", group_start="contains:'License'", filter_matches="contains:'token'").rows.select("doc_id", "group_ix", "page_no")), f"WITH {LONG}, h AS (SELECT doc_id, page_no, text, CAST(sum(CASE WHEN page_no = 1 OR contains(text, 'License') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_no) AS INTEGER) AS group_ix FROM q), k AS (SELECT doc_id, group_ix FROM h GROUP BY 1, 2 HAVING bool_or(contains(text, 'token'))) SELECT h.doc_id, h.group_ix, page_no FROM h JOIN k ON k.doc_id = h.doc_id AND k.group_ix = h.group_ix")

# --- any number of arguments -------------------------------------------------------------------------------------------

MANY = 10_000
MANY_SPANS = ",".join(f"{i}-{i + i % 7}" for i in range(1, MANY + 1))
FOUR_LETTERS = ["".join(x) for x in itertools.product("abcdefghij", repeat=4)]  # as many texts
MANY_TEXTS = ",".join(f"contains:'{x}'" for x in FOUR_LETTERS)
#: t: the four letters at each place of a text; k: their number among all such.
FOURS = "t AS (SELECT DISTINCT doc_id, page_no, substr({0}, CAST(i AS INTEGER), 4) AS t FROM (SELECT *, unnest(range(1, length({0}) - 2)) AS i FROM {1}) WHERE regexp_full_match(substr({0}, CAST(i AS INTEGER), 4), '[a-j]{{4}}')), k AS (SELECT *, CAST(1 + 1000 * (ascii(t) - 97) + 100 * (ascii(substr(t, 2)) - 97) + 10 * (ascii(substr(t, 3)) - 97) + ascii(substr(t, 4)) - 97 AS INTEGER) AS group_ix FROM t)"
query("f3_many_spans", on_sources(lambda p: PageQuery(p, on_error="ignore").select(MANY_SPANS).rows), f"WITH {LONG}, a AS (SELECT i AS group_ix, i AS lo, i + i % 7 AS hi FROM range(1, {MANY + 1}) r(i)) SELECT doc_id, CAST(group_ix AS INTEGER) AS group_ix, page_no AS pos, page_no, lo || '-' || hi AS spec, true AS is_range, false AS preserve_order FROM q JOIN a ON page_no BETWEEN lo AND hi AND n >= hi")
query("f3_many_texts", on_conversations(lambda p: PageQuery(p).select(MANY_TEXTS).rows), f"WITH {CONVERSATIONS}, {FOURS.format('text', 'p')} SELECT doc_id, group_ix, page_no AS pos, page_no, 'contains:' || chr(39) || t || chr(39) AS spec, count(*) OVER (PARTITION BY doc_id, group_ix) > 1 AS is_range, true AS preserve_order FROM k")
query("f3_mixed_table", on_conversations(lambda p: plan_table(p, "1-2,last 2,contains:'the',odd,!contains:'and',first 1,contains/i:'LA',2-1")), f"WITH {CONVERSATIONS}, {COUNTED}, a AS (SELECT *, 1 AS g, '1-2' AS spec FROM q WHERE page_no <= 2 UNION ALL SELECT *, 2, 'last 2' FROM q WHERE page_no > n - 2 UNION ALL SELECT *, 3, $$contains:'the'$$ FROM q WHERE contains(text, 'the') UNION ALL SELECT *, 4, 'odd' FROM q WHERE page_no % 2 = 1 UNION ALL SELECT *, 5, $$!contains:'and'$$ FROM q WHERE NOT contains(text, 'and') UNION ALL SELECT *, 6, 'first 1' FROM q WHERE page_no = 1 UNION ALL SELECT *, 7, $$contains/i:'LA'$$ FROM q WHERE contains(lower(text), 'la') UNION ALL SELECT *, 8, '2-1' FROM q WHERE page_no <= 2) SELECT doc_id, CAST(g AS INTEGER) AS group_ix, CASE WHEN g = 8 THEN -page_no ELSE page_no END AS pos, page_no, spec, CASE WHEN g IN (3, 5, 7) THEN count(*) OVER (PARTITION BY doc_id, g) > 1 ELSE g <> 4 END AS is_range, true AS preserve_order FROM a WHERE n >= 2")


def plan_table(pages: DataFrame, expression: str) -> DataFrame:
    return arguments.select_table(pages, parse(expression))


PROBLEM = "2,contains:'und' to contains:'la',4-,9-6"
query("q3_problems", on_conversations(lambda p: PageQuery(p).problems(PROBLEM)), f"WITH {CONVERSATIONS}, {COUNTED}, d AS (SELECT doc_id, max(n) AS n, bool_or(contains(text, 'und')) AS a, bool_or(contains(text, 'und') AND EXISTS (SELECT 1 FROM p e WHERE e.doc_id = q.doc_id AND e.page_no >= q.page_no AND contains(e.text, 'la'))) AS s FROM q GROUP BY 1) SELECT doc_id, CAST(1 AS INTEGER) AS argument, '2' AS spec, 'page 2 of ' || n AS reason FROM d WHERE n < 2 UNION ALL SELECT doc_id, 2, $$contains:'und' to contains:'la'$$, CASE WHEN a THEN 'no end behind a start' ELSE 'no start' END FROM d WHERE NOT s UNION ALL SELECT doc_id, 3, '4-', 'page 4 of ' || n FROM d WHERE n < 4 UNION ALL SELECT doc_id, 4, '9-6', 'page 9 of ' || n FROM d WHERE n < 9")

# --- documents and analysis -------------------------------------------------------------------------------------------

query("a1_document_info", on_conversations(lambda p: relations.document_info(p).select("doc_id", "page_count", F.round("size_mb", 9).alias("size_mb"))), f"WITH {CONVERSATIONS} SELECT doc_id, max(page_no) AS page_count, round(sum(size_bytes) / 1048576, 9) AS size_mb FROM p GROUP BY 1")
query("a8_clean_text", lambda s, d: relations.read(s, d, "documents").select("doc_id", F.md5(text.clean_text(F.col("text")).cast("binary")).alias("clean")), r"SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10))) AS clean FROM documents")
query("j1_summary", on_conversations(analysis.summary), f"WITH {CONVERSATIONS} SELECT doc_id, count(*) AS total_pages, CAST(sum(size_bytes) AS BIGINT) AS total_size, CAST(floor(sum(size_bytes) / count(*)) AS BIGINT) AS average_size FROM p GROUP BY 1")
query("j2_types", on_conversations(analysis.type_distribution), f"WITH {CONVERSATIONS}, t AS (SELECT *, {TYPE} AS page_type FROM p), c AS (SELECT doc_id, page_type, count(*) AS n, CAST(floor(sum(size_bytes) / count(*)) AS BIGINT) AS average_size FROM t GROUP BY 1, 2) SELECT doc_id, CAST(CASE page_type WHEN 'text' THEN 1 WHEN 'mixed' THEN 2 WHEN 'image' THEN 3 ELSE 4 END AS INTEGER) AS type_ix, page_type, n, round(100 * n / sum(n) OVER (PARTITION BY doc_id), 1) AS percent, average_size FROM c")
query("j3_histogram", on_sources(analysis.size_histogram), f"WITH {SOURCES} SELECT doc_id, CASE WHEN size_bytes < 51200 THEN '<50KB' WHEN size_bytes < 204800 THEN '50-200KB' WHEN size_bytes < 1048576 THEN '200KB-1MB' WHEN size_bytes < 5242880 THEN '1-5MB' ELSE '>=5MB' END AS size_bin, count(*) AS n FROM p GROUP BY 1, 2")
query("j4_page_table", on_conversations(lambda p: analysis.page_table(p)), f"WITH {CONVERSATIONS}, t AS (SELECT *, {TYPE} AS page_type, length({TRIM.format('text')}) AS c FROM p) SELECT doc_id, page_no AS page, page_type, size_bytes, CASE WHEN page_type = 'empty' THEN '(Empty or minimal content)' WHEN page_type = 'image' AND image_count = 1 THEN '(Single image/scan)' WHEN page_type = 'image' THEN '(' || image_count || ' images/scanned content)' WHEN page_type = 'mixed' THEN '(Mixed: ' || lpad(format('{{:,}}', c), 5, ' ') || ' chars + ' || lpad(CAST(image_count AS VARCHAR), 2, ' ') || ' images)' WHEN c > 500 THEN '(Substantial text content)' ELSE '(Text content)' END AS content FROM t")
query("j6_samples", on_conversations(lambda p: p.select("doc_id", "page_no", analysis.sample_text(F.col("text")).alias("sample"))), rf"WITH {CONVERSATIONS}, t AS (SELECT doc_id, page_no, {TRIM.format('text')} AS t, trim(regexp_replace(text, '\s+', ' ', 'g')) AS w FROM p), u AS (SELECT *, coalesce(list_filter(list_transform(string_split_regex(w, '[.!?]+'), lambda x: trim(x)), lambda x: length(x) > 10)[1], w) AS s FROM t) SELECT doc_id, page_no, CASE WHEN length(t) >= 20 THEN chr(34) || CASE WHEN length(s) > 30 THEN s[1:27] || '...' ELSE s END || chr(34) END AS sample FROM u")
query("j7_document_analysis", on_conversations(lambda p: analysis.document_analysis(p).select("doc_id", "page_count", F.round("mb_per_page", 9).alias("mb_per_page"), "has_text", "has_images")), rf"WITH {CONVERSATIONS} SELECT doc_id, max(page_no) AS page_count, round(sum(size_bytes) / 1048576 / max(page_no), 9) AS mb_per_page, bool_or(page_no <= 3 AND regexp_matches(text, '\S')) AS has_text, bool_or(page_no <= 3 AND image_count > 0) AS has_images FROM p GROUP BY 1")
query("j8_large", on_sources(lambda p: analysis.large_documents(p, 0.1, 0.01).select("doc_id")), f"WITH {SOURCES} SELECT doc_id FROM p GROUP BY 1 HAVING sum(size_bytes) / 1048576 > 0.1 OR sum(size_bytes) / 1048576 / max(page_no) > 0.01")
query("j9_malformations", on_conversations(analysis.malformation_summary), f"WITH {CONVERSATIONS}, {COUNTED} SELECT 'Resource duplication' AS kind, count(DISTINCT doc_id) AS n FROM q WHERE page_no <= 3 AND image_count > 0 AND image_count >= 0.5 * n")
query("j10_malformed", on_conversations(analysis.malformed), f"WITH {CONVERSATIONS}, {COUNTED} SELECT DISTINCT doc_id, 'Resource duplication' AS kind FROM q WHERE page_no <= 3 AND image_count > 0 AND image_count >= 0.5 * n")
query("j15_text_counts", on_conversations(analysis.text_counts), rf"WITH {CONVERSATIONS}, t AS (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S'))) AS k FROM p) SELECT doc_id, count(*) FILTER (WHERE k > 0) AS pages_with_text, CAST(sum(k) AS BIGINT) AS non_blank_lines FROM t GROUP BY 1")
query("q8_listing", on_conversations(lambda p: analysis.listing(p).select("doc_id", "page_count", "kind", "malformed")), f"WITH {CONVERSATIONS}, {COUNTED} SELECT doc_id, max(page_no) AS page_count, CASE WHEN max(page_no) > 1 THEN 'multi' ELSE 'single' END AS kind, bool_or(page_no <= 3 AND image_count > 0 AND image_count >= 0.5 * n) AS malformed FROM q GROUP BY 1")
query("m2_analysis", on_conversations(lambda p: analysis.analyze(p).withColumns({k: F.round(k, 9) for k in ("size_kb", "size_mb", "confidence")})), f"WITH {CONVERSATIONS}, t AS (SELECT *, length({TRIM.format('text')}) AS c FROM p) SELECT doc_id, page_no AS page_number, {TYPE} AS page_type, size_bytes, round(size_bytes / 1024, 9) AS size_kb, round(size_bytes / 1048576, 9) AS size_mb, CAST(c AS INTEGER) AS text_length, image_count, c >= 50 AS has_meaningful_text, round(CASE WHEN c >= 50 AND image_count > 0 THEN 0.75 + 0.2 * (1 - abs(least(c / 500, 1.0) - least(image_count / 5, 1.0))) WHEN c >= 50 THEN CASE WHEN c > 200 THEN 0.95 ELSE 0.85 END WHEN image_count > 0 THEN 0.9 ELSE 0.95 END, 9) AS confidence FROM t")
query("m1_html_types", lambda s, d: analysis.type_distribution(relations.html_pages(s, d)).groupBy("page_type").agg(F.sum("n").alias("n")), r"SELECT CASE WHEN length(regexp_replace(html, '^\s+|\s+$', '', 'g')) >= 50 THEN CASE WHEN regexp_matches(html, '(?i)<img') THEN 'mixed' ELSE 'text' END WHEN regexp_matches(html, '(?i)<img') THEN 'image' ELSE 'empty' END AS page_type, CAST(count(*) AS BIGINT) AS n FROM pages GROUP BY 1")
query("lines_as_pages", lambda s, d: relations.document_info(relations.document_lines(s, d)).select("doc_id", "page_count"), "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS page_count FROM documents")

# --- trimming, names, cells -------------------------------------------------------------------------------------------

WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')"


def on_documents(value: Callable[[], object]):
    return lambda s, d: relations.read(s, d, "documents").select("doc_id", value().alias("value"))


def trimmed(block: str, from_start: bool = True):
    return on_documents(lambda: trimming.trim(F.col("text"), parse_trimmers(block) if from_start else (), () if from_start else parse_trimmers(block)))


def per_document(name: str, build, sql: str) -> None:
    query(name, build, f"SELECT doc_id, {sql} AS value FROM documents")


NUMBERS, BETWEEN = "regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*')", "string_split_regex(text, '[0-9]+(?:[.,][0-9]+)*')"
per_document("o2_trim_characters", trimmed("ch20"), "CASE WHEN length(text) <= 20 THEN '' ELSE substr(text, 21) END")
per_document("o2_trim_characters_end", trimmed("ch20", False), "CASE WHEN length(text) <= 20 THEN '' ELSE substr(text, 1, length(text) - 20) END")
per_document("o3_trim_words", trimmed("wd3"), f"array_to_string(({WORDS})[4:], ' ')")
per_document("o3_trim_words_end", trimmed("wd3", False), f"CASE WHEN len({WORDS}) <= 3 THEN '' ELSE array_to_string(({WORDS})[1:len({WORDS}) - 3], ' ') END")
per_document("o4_trim_lines", trimmed("ln1"), "array_to_string(string_split(text, chr(10))[2:], chr(10))")
per_document("o5_trim_numbers", trimmed("nb1"), f"CASE WHEN len({NUMBERS}) < 1 THEN '' ELSE substr(text, length({BETWEEN}[1]) + length({NUMBERS}[1]) + 1) END")
per_document("o6_trim_numbers_end", trimmed("nb1", False), f"CASE WHEN len({NUMBERS}) < 1 THEN '' ELSE substr(text, 1, length(text) - length({BETWEEN}[-1]) - length({NUMBERS}[-1])) END")
query("o7_trimmers", lambda s, d: relations.read(s, d, "documents").select("doc_id", trimming.trim(F.col("text"), parse_trimmers("wd1ch4"), parse_trimmers("wd2")).alias("value")), f"WITH a AS (SELECT doc_id, array_to_string(({WORDS})[2:], ' ') AS text FROM documents), b AS (SELECT doc_id, CASE WHEN length(text) <= 4 THEN '' ELSE substr(text, 5) END AS text FROM a) SELECT doc_id, CASE WHEN len({WORDS}) <= 2 THEN '' ELSE array_to_string(({WORDS})[1:len({WORDS}) - 2], ' ') END AS value FROM b")
FILENAME = r"regexp_replace(CASE WHEN regexp_matches({0}, '^[$£€¥]?[\d,]+') THEN replace(regexp_replace({0}, '[$£€¥,]', '', 'g'), '.', '-') ELSE regexp_replace({0}, '[^\p{{L}}\p{{N}}_.\-]', '-', 'g') END, '-+', '-', 'g')"
query("o10_filename", lambda s, d: relations.read(s, d, "documents").select("doc_id", names.sanitize_filename(F.col("text")).alias("value")), "WITH a AS (SELECT doc_id, regexp_replace(" + FILENAME.format(TRIM.format("text")) + r", '^[-.]+|[-.]+$', '', 'g') AS x FROM documents) SELECT doc_id, CASE WHEN x = '' THEN 'unknown' WHEN length(x) > 50 THEN regexp_replace(substr(x, 1, 50), '[-.]+$', '') ELSE x END AS value FROM a")
query("o15_template", lambda s, d: relations.read(s, d, "pages").select("page_id", names.template_name("{lang|none}_{missing}_pages{range}", {"lang": F.nullif(F.regexp_extract("url", "://[^/]*/([a-z]+)/", 1), F.lit("")), "missing": F.lit(None).cast("string")}, F.lit("x"), F.lpad(F.col("page_id").cast("string"), 3, "0")).alias("value")), r"SELECT page_id, coalesce(nullif(regexp_extract(url, '://[^/]*/([a-z]+)/', 1), ''), 'none') || '_NO-MISSING_pages' || CASE WHEN length(CAST(page_id AS VARCHAR)) >= 3 THEN substr(CAST(page_id AS VARCHAR), 1, 3) ELSE lpad(CAST(page_id AS VARCHAR), 3, '0') END || '.pdf' AS value FROM pages")
query("o19_description", lambda s, d: relations.read(s, d, "pages").select("page_id", names.sanitize_description(F.col("url")).alias("value")), r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '[<>:"/\\|?*]', '_', 'g'), '\s+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS value FROM pages""")
query("o20_extraction_name", lambda s, d: relations.read(s, d, "pages").select("page_id", names.extraction_name(F.concat(F.lit("page"), F.col("page_id").cast("string")), F.lit("pages1-3"), "grouped").alias("value")), "SELECT page_id, 'page' || page_id || '_groups_pages1-3.pdf' AS value FROM pages")
per_document("o24_cells", on_documents(lambda: names.clean_cell(F.col("text"))), r"trim(regexp_replace(replace(text, chr(13), ''), '\s+', ' ', 'g'))")
query("o25_numbers", lambda s, d: relations.read(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum(names.looks_like_number(F.concat(F.lit("$ "), F.format_number("l_extendedprice", 2))).cast("long")).alias("n")), "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1")
query("o26_sizes", on_sources(lambda p: p.select("doc_id", "page_no", format_size(F.col("size_bytes")).alias("value"))), f"WITH {SOURCES} SELECT doc_id, page_no, CASE WHEN size_bytes < 1024 THEN size_bytes || ' B' WHEN size_bytes < 1048576 THEN printf('%.1f KB', size_bytes / 1024) ELSE printf('%.1f MB', size_bytes / 1048576) END AS value FROM p")
per_document("o31_hashes", on_documents(lambda: names.content_hash(F.col("text"))), "sha256(text)")
per_document("o8_trim_warnings", on_documents(lambda: F.size(trimming.trim_warnings(F.col("text"), [("ch", 40), ("wd", 5), ("ln", 1), ("nb", 1)]))), f"CAST((length(text) <= 40)::INT + (len({WORDS}) <= 5)::INT + (len(string_split(text, chr(10))) <= 1)::INT AS INTEGER)")
CONTENT = r"regexp_replace(regexp_replace({0}, '-+', '-', 'g'), '^-+|-+$', '', 'g')"
for kind, bare in (("number", r"regexp_replace({0}, '[^0-9.\-]', '-', 'g')"), ("date", r"regexp_replace(regexp_replace({0}, '[/\\]', '-', 'g'), '(?:,|\s+)+', '-', 'g')")):
    found = CONTENT.format(bare.format(TRIM.format("text")))
    per_document(f"o11_content_{kind}", on_documents(lambda kind=kind: names.sanitize_content(F.col("text"), kind)), f"CASE WHEN NOT regexp_matches(text, '\\S') THEN 'empty' WHEN {found} = '' THEN 'content' ELSE {found} END")
LANGUAGE = "nullif(regexp_extract(url, '://[^/]*/([a-z]+)/', 1), '')"
query("o32_smart_names", lambda s, d: relations.read(s, d, "pages").select("page_id", names.smart_name("{lang}-{range}", {"lang": F.nullif(F.regexp_extract("url", "://[^/]*/([a-z]+)/", 1), F.lit(""))}, F.lit("stem"), F.lit("2-4")).alias("value")), f"SELECT page_id, CASE WHEN {LANGUAGE} IS NULL THEN 'stem_pages2-4.pdf' ELSE {LANGUAGE} || '-2-4.pdf' END AS value FROM pages")
query("o27_estimates", lambda s, d: relations.read(s, d, "lineitem").select("l_orderkey", "l_linenumber", names.estimated_pages(F.concat_ws("-", F.col("l_linenumber").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, F.lit("9")))).alias("value")), "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_linenumber % 2 = 0 THEN 9 - l_linenumber + 1 ELSE 1 END AS INTEGER) AS value FROM lineitem")
query("o27_lists", lambda s, d: relations.read(s, d, "orders").select("o_orderkey", names.estimated_pages(F.concat_ws(",", F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, F.lit(" 7")), F.when(F.col("o_orderkey") % 3 == 0, F.lit("x")), F.when(F.col("o_orderkey") % 5 == 0, F.lit("8")))).alias("value")), "SELECT o_orderkey, CAST(1 + (o_orderkey % 2 = 0)::INT + (o_orderkey % 5 = 0)::INT AS INTEGER) AS value FROM orders")
query("j11_table_stats", lambda s, d: analysis.table_stats(relations.read(s, d, "documents").select("text", "lang", "source")).select("rows", "columns", "empty_cells", "filled_cells"), r"SELECT count(*) AS rows, CAST(3 AS INTEGER) AS columns, count(*) FILTER (WHERE NOT regexp_matches(text, '\S')) AS empty_cells, 3 * count(*) - count(*) FILTER (WHERE NOT regexp_matches(text, '\S')) AS filled_cells FROM documents")

# --- extraction -------------------------------------------------------------------------------------------------------

SCRAPE = {"licence": parse_legacy("License:right:0:text"), "before": parse_legacy("License:left:1:word")}
query("l23_scrape", on_sources(lambda p: extract.scrape(p, SCRAPE)), r"""WITH """ + SOURCES + r""", k AS (SELECT doc_id, page_no, list_filter(string_split(text, chr(10)), lambda x: contains(lower(x), 'license'))[1] AS line FROM p),
 w AS (SELECT doc_id, page_no, list_filter(string_split_regex(line, '\s+'), lambda x: x <> '') AS w, strpos(lower(line), 'license') - 1 AS k0 FROM k WHERE line IS NOT NULL),
 i AS (SELECT *, len(list_filter(range(1, len(w) + 1), lambda j: length(array_to_string(w[1:j], ' ')) + 1 <= k0)) AS a, len(list_filter(range(1, len(w) + 1), lambda j: length(array_to_string(w[1:j], ' ')) + 1 < k0 + 7)) AS b FROM w),
 o AS (SELECT doc_id AS filename, page_no AS page, CASE WHEN b + 1 < len(w) THEN array_to_string(w[b + 2:], ' ') END AS licence, CASE WHEN a >= 1 THEN w[a] END AS before FROM i WHERE b < len(w))
 SELECT filename, page, coalesce(licence, '') AS licence, coalesce(before, '') AS before FROM o WHERE licence IS NOT NULL OR before IS NOT NULL""")
query("l22_keyword_words", on_sources(lambda p: extract.legacy_matches(p, "licens").groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))), rf"WITH {SOURCES}, w AS (SELECT doc_id, unnest(list_filter(string_split_regex(text, '\s+'), lambda x: contains(lower(x), 'licens'))) AS word FROM p) SELECT doc_id, word, count(*) AS n FROM w GROUP BY 1, 2")
COMPACT = ["version=Version:r1nb1pg0mt0", "licence=License:wd1pg0", "by=Licensed:r1wd3-pg0mt-1"]
#: x: the words of pages by line and place, with the line's words (w), the words after (x1, x2, x3), the page's lines (ls), and c, the word's letters and digits.
PAGE_WORDS = SOURCES + r""", l AS (SELECT doc_id, page_no, string_split(text, chr(10)) AS ls, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM p),
 v AS (SELECT *, list_filter(string_split_regex(t, '\s+'), lambda x: x <> '') AS w FROM l),
 u AS (SELECT *, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS word FROM v),
 x AS (SELECT *, regexp_replace(lower(x), '[^\p{L}\p{N}]', '', 'g') AS c, lead(x, 1) OVER o AS x1, lead(x, 2) OVER o AS x2, lead(x, 3) OVER o AS x3 FROM u WINDOW o AS (PARTITION BY doc_id, page_no ORDER BY line, word))"""
NUMBER = "'-?[0-9]+(?:[.,][0-9]+)*'"
EXTRACTED = PAGE_WORDS + rf""", m AS (SELECT doc_id, 0 AS pattern, page_no, line, word, nullif(regexp_extract(array_to_string(w[least(n - 1, word + 1) + 1:], ' '), {NUMBER}), '') AS value FROM x WHERE contains(c, 'version')
  UNION ALL SELECT doc_id, 1, page_no, line, word, x FROM x WHERE contains(c, 'license')
  UNION ALL SELECT doc_id, 2, page_no, line, word, CASE WHEN word < n - 1 THEN concat_ws(' ', x1, x2, x3) ELSE concat_ws(' ', x, x1, x2) END FROM x WHERE contains(c, 'licensed')),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pattern ORDER BY page_no, line, word) AS place, count(*) OVER (PARTITION BY doc_id, pattern) AS k FROM m),
 s AS (SELECT doc_id, pattern, max(k) AS k, count(*) FILTER (WHERE pattern = 0 OR pattern = 1 AND place = 1 OR pattern = 2 AND place = k) > 0 AS success,
   list(value ORDER BY place) FILTER (WHERE pattern = 0 OR pattern = 1 AND place = 1 OR pattern = 2 AND place = k) AS got FROM r GROUP BY 1, 2),
 a AS (SELECT d.doc_id, n.i AS pattern, n.variable, coalesce(success, false) AS success, coalesce(k, 0) AS k, got FROM (SELECT DISTINCT doc_id FROM p) d CROSS JOIN (VALUES (0, 'version'), (1, 'licence'), (2, 'by')) n(i, variable) LEFT JOIN s ON s.doc_id = d.doc_id AND s.pattern = n.i)"""
query("l15_extract", on_sources(lambda p: extract.extract(p, parse_patterns(COMPACT)).select("doc_id", "variable", "success", "n_matches", F.array_join("selected", "|").alias("selected"))), f"WITH {EXTRACTED} SELECT doc_id, variable, success, CAST(k AS INTEGER) AS n_matches, coalesce(array_to_string(list_filter(got, lambda y: y IS NOT NULL), '|'), '') AS selected FROM a")
query("l17_variables", on_sources(lambda p: extract.variables(p, parse_patterns(COMPACT))), f"WITH {EXTRACTED} SELECT doc_id, " + ", ".join(f"max(CASE WHEN pattern = {i} THEN CASE WHEN success THEN got[1] ELSE 'No_Match' END END) AS {v}" for i, v in enumerate(("version", "licence", "by"))) + " FROM a GROUP BY 1")
query("l14_warnings", on_sources(lambda p: extract.extract(p, parse_patterns(COMPACT)).select("doc_id", "variable", F.array_join("warnings", ";").alias("warnings"))), f"WITH {EXTRACTED} SELECT doc_id, variable, CASE WHEN k = 0 THEN 'keyword ' || chr(39) || (['Version', 'License', 'Licensed'])[pattern + 1] || chr(39) || ' not found' WHEN NOT success THEN 'no such match' WHEN len(got) > 1 THEN 'several matches' ELSE '' END AS warnings FROM a")

#: Moves (L10), words, lines and numbers (L11 to L13), all of a line and flexible ones, each with the content by SQL over x.
WALKS = {
    # a start of a blank line is no place, and gives nothing
    "License:u1ln1": r"CASE WHEN regexp_matches(ls[greatest(line - 1, 0) + 1], '\S') THEN ls[greatest(line - 1, 0) + 1] END",
    "License:d1ln2": r"CASE WHEN regexp_matches(ls[least(line + 1, len(ls) - 1) + 1], '\S') THEN array_to_string(ls[least(line + 1, len(ls) - 1) + 1:least(line + 1, len(ls) - 1) + 2], chr(10)) END",
    "License:l2wd2": "array_to_string(w[greatest(word - 2, 0) + 1:greatest(word - 2, 0) + 2], ' ')",
    "License:wd0": "array_to_string(w[word + 1:], ' ')",
    "License:d1wd1": "list_filter(string_split_regex(ls[least(line + 1, len(ls) - 1) + 1], '\\s+'), lambda y: y <> '')[1]",
    "License:nb2": f"nullif(array_to_string(regexp_extract_all(array_to_string(w[word + 1:], ' '), {NUMBER})[1:2], ' '), '')",
    "License:r1wd3-": "CASE WHEN word < n - 1 THEN concat_ws(' ', x1, x2, x3) ELSE concat_ws(' ', x, x1, x2) END",
    "License:ln1": "ls[line + 1]",
}
WALKS_SQL = " UNION ALL ".join(f"SELECT doc_id, page_no, CAST({i} AS INTEGER) AS pattern, CAST(line AS INTEGER) AS line, CAST(word AS INTEGER) AS word, {sql} AS extracted FROM x WHERE contains(c, 'license')" for i, sql in enumerate(WALKS.values()))
query("l10_walks", on_sources(lambda p: extract.matches(p, parse_patterns([f"v{i}={x}" for i, x in enumerate(WALKS)])).select("doc_id", "page_no", "pattern", "line", "word", "extracted")), f"WITH {PAGE_WORDS} {WALKS_SQL}")
TRIMMED = ["value=License:r1wd4_^ch1$ch2pg0mt0", "single=License:wd2pg2", "later=License:wd1pg2-3mt2", "least=License:ln1pg-2mt-2"]
PICKED = r"""SELECT doc_id, '{0}' AS variable, {1} AS value, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, line, word) AS place, count(*) OVER (PARTITION BY doc_id) AS k FROM x WHERE contains(c, 'license') AND {2}"""
ALL_BUT_SPACES = "replace(array_to_string(w[least(n - 1, word + 1) + 1:least(n - 1, word + 1) + 4], ' '), ' ', '')"
query("l12_picks", on_sources(lambda p: extract.extract(p, parse_patterns(TRIMMED)).where("success").select("doc_id", "variable", F.array_join("selected", "|").alias("selected"))), f"WITH {PAGE_WORDS}, o AS (SELECT doc_id AS d, max(page_no) AS last FROM p GROUP BY 1), m AS (" + " UNION ALL ".join([
    PICKED.format("value", f"CASE WHEN length({ALL_BUT_SPACES}) <= 3 THEN '' ELSE substr({ALL_BUT_SPACES}, 2, length({ALL_BUT_SPACES}) - 3) END", "true"),
    PICKED.format("single", "array_to_string(w[word + 1:word + 2], ' ')", "page_no = 2"),
    PICKED.format("later", "x", "page_no BETWEEN 2 AND 3"),
    PICKED.format("least", "ls[line + 1]", "page_no > (SELECT last FROM o WHERE d = doc_id) - 2"),
]) + ") SELECT doc_id, variable, string_agg(value, '|' ORDER BY place) AS selected FROM m WHERE variable = 'value' OR variable = 'single' AND place = 1 OR variable = 'later' AND place = 2 OR variable = 'least' AND place > k - 2 GROUP BY 1, 2")

SIDES = {"above": parse_legacy("License:above:1:line"), "word": parse_legacy("License:below:1:word"), "number": parse_legacy("License:right:0:number")}
query("l20_sides", on_sources(lambda p: extract.scrape(p, SIDES)), r"WITH " + SOURCES + r""", k AS (SELECT doc_id, page_no, string_split(text, chr(10)) AS ls, list_position(list_transform(string_split(text, chr(10)), lambda x: contains(lower(x), 'license')), true) AS i FROM p),
 w AS (SELECT *, list_filter(string_split_regex(ls[i], '\s+'), lambda x: x <> '') AS w, strpos(lower(ls[i]), 'license') - 1 AS k0 FROM k WHERE i > 0),
 b AS (SELECT *, len(list_filter(range(1, len(w) + 1), lambda j: length(array_to_string(w[1:j], ' ')) + 1 < k0 + 7)) AS b, list_filter(string_split_regex(ls[i + 1], '\s+'), lambda x: x <> '') AS w1 FROM w),
 o AS (SELECT doc_id AS filename, page_no AS page, CASE WHEN i > 1 AND regexp_matches(ls[i - 1], '\S') THEN regexp_replace(ls[i - 1], '^\s+|\s+$', '', 'g') END AS above, w1[1] AS word,
   list_filter(list_transform(w[b + 2:b + 4], lambda x: regexp_extract(x, '-?[0-9]+(?:[.,][0-9]+)*')), lambda x: x <> '')[1] AS number FROM b WHERE b < len(w))
 SELECT filename, page, coalesce(above, '') AS above, coalesce(word, '') AS word, coalesce(number, '') AS number FROM o WHERE coalesce(above, word, number) IS NOT NULL""")
query("l24_debug", on_sources(lambda p: extract.debug(p, parse_patterns(["License:l1wd1"])[0]).select("doc_id", "page_no", "line", "word", "match_text", "target_line", "target_word", "extracted", F.md5(F.col("line_text").cast("binary")).alias("line_text"))), f"WITH {PAGE_WORDS} SELECT doc_id, page_no, CAST(line AS INTEGER) AS line, CAST(word AS INTEGER) AS word, x AS match_text, CAST(line AS INTEGER) AS target_line, CAST(greatest(word - 1, 0) AS INTEGER) AS target_word, w[greatest(word - 1, 0) + 1] AS extracted, md5(t) AS line_text FROM x WHERE contains(c, 'license')")
query("l9_matches", on_sources(lambda p: extract.matches(p, parse_patterns(["License:wd1"])).select("doc_id", "page_no", "line", "word", "match_text")), rf"WITH {SOURCES}, l AS (SELECT doc_id, page_no, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM p), w AS (SELECT doc_id, page_no, line, unnest(list_filter(string_split_regex(t, '\s+'), lambda x: x <> '')) AS match_text, generate_subscripts(list_filter(string_split_regex(t, '\s+'), lambda x: x <> ''), 1) - 1 AS word FROM l) SELECT doc_id, page_no, CAST(line AS INTEGER) AS line, CAST(word AS INTEGER) AS word, match_text FROM w WHERE contains(regexp_replace(lower(match_text), '[^\p{{L}}\p{{N}}]', '', 'g'), 'license')")


query("l9_many_keywords", on_sources(lambda p: extract.matches(p, many_patterns()).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id", "page_no").alias("pages"))), f"WITH {PAGE_WORDS}, y AS (SELECT DISTINCT c, doc_id, page_no, line, word, substr(c, CAST(i AS INTEGER), 4) AS t FROM (SELECT *, unnest(range(1, length(c) - 2)) AS i FROM x) WHERE regexp_full_match(substr(c, CAST(i AS INTEGER), 4), '[a-j]{{4}}')) SELECT CAST(1000 * (ascii(t) - 97) + 100 * (ascii(substr(t, 2)) - 97) + 10 * (ascii(substr(t, 3)) - 97) + ascii(substr(t, 4)) - 97 AS INTEGER) AS pattern, count(*) AS n, count(DISTINCT (doc_id, page_no)) AS pages FROM y GROUP BY t")
query("l22_many_words", on_sources(lambda p: extract.legacy_matches_of(p, FOUR_LETTERS).groupBy("keyword", "word").agg(F.count(F.lit(1)).alias("n"))), rf"WITH {SOURCES}, w AS (SELECT unnest(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS word FROM p), u AS (SELECT word, count(*) AS n FROM w GROUP BY 1), y AS (SELECT DISTINCT word, n, substr(lower(word), CAST(i AS INTEGER), 4) AS keyword FROM (SELECT *, unnest(range(1, length(word) - 2)) AS i FROM u) WHERE regexp_full_match(substr(lower(word), CAST(i AS INTEGER), 4), '[a-j]{{4}}')) SELECT keyword, word, n FROM y")


def many_patterns() -> list:
    return parse_patterns([f"v{i}={x}:wd1" for i, x in enumerate(FOUR_LETTERS)])


# --- layout -----------------------------------------------------------------------------------------------------------


def characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character boxes for the benchmark's texts: five units a character, ten a line."""
    lines = relations.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("line", "t"))
    chars = lines.select("doc_id", "line", F.posexplode(F.filter(F.split("t", ""), lambda c: c != "")).alias("i", "text"))
    return chars.select("doc_id", F.lit(1).alias("page_no"), "text", (5.0 * F.col("i")).alias("x0"), (5.0 * F.col("i") + 5).alias("x1"), (1000.0 - 10 * F.col("line")).alias("y1"))


query("k5_layout", lambda s, d: layout.page_texts(characters(s, d)), r"SELECT item_id AS doc_id, CAST(1 AS INTEGER) AS page_no, array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')), chr(10)) AS text FROM benchmark WHERE regexp_matches(text, '\S')")
query("k6_layout_fixed", lambda s, d: layout.page_texts(characters(s, d), fixed_keep=6.0), r"SELECT item_id AS doc_id, CAST(1 AS INTEGER) AS page_no, array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')), chr(10)) AS text FROM benchmark WHERE regexp_matches(text, '\S')")



def uneven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with widths and distances that differ, a wide gap after each seventh character, and heights that leave their line here and there."""
    i, low = F.col("i"), F.when(F.floor(F.col("i") / 20) % 2 == 1, 1.5 * (F.col("i") % 3)).otherwise(0.0)
    x0 = 5.0 * i + 6.0 * F.floor(i / 7) + 0.25 * ((i * i) % 5)
    lines = relations.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("line", "t"))
    chars = lines.select("doc_id", "line", F.posexplode(F.filter(F.split("t", ""), lambda c: c != "")).alias("i", "text"))
    return chars.select("doc_id", F.lit(1).alias("page_no"), "text", x0.alias("x0"), (x0 + 4 + i % 3).alias("x1"), (1000.0 - 10 * F.col("line") - low).alias("y1"))


def uneven_sql(keep: str, space: str, tab: str | None) -> str:
    tabbed = f"WHEN nx - center >= {tab} THEN chr(9) " if tab else ""
    return rf"""WITH t AS (SELECT item_id AS doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM benchmark),
 c AS (SELECT doc_id, line, unnest(string_split(t, '')) AS ch, generate_subscripts(string_split(t, ''), 1) - 1 AS i FROM t WHERE t <> ''),
 b AS (SELECT *, 5.0::DOUBLE * i + 6 * (i // 7) + 0.25::DOUBLE * ((i * i) % 5) AS x0, (i // 20) % 2 = 1 AND i % 3 = 2 AS low, ch = ' ' AS blank FROM c),
 e AS (SELECT *, (x0 + x0 + 4 + i % 3) / 2 AS center FROM b),
 g AS (SELECT *, CASE WHEN NOT blank THEN center - lag(center) OVER (PARTITION BY doc_id, line, low, blank ORDER BY x0) END AS gap FROM e),
 s AS (SELECT *, coalesce(quantile_cont(CASE WHEN gap > 0 AND gap < 50 THEN gap END, 0.5) OVER (PARTITION BY doc_id, line, low), 4.8) AS unit FROM g),
 n AS (SELECT *, last_value(CASE WHEN NOT blank THEN center END IGNORE NULLS) OVER (PARTITION BY doc_id, line, low ORDER BY x0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bef,
   first_value(CASE WHEN NOT blank THEN center END IGNORE NULLS) OVER (PARTITION BY doc_id, line, low ORDER BY x0 ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS aft,
   lead(center) OVER (PARTITION BY doc_id, line, low ORDER BY x0) AS nx, lead(blank) OVER (PARTITION BY doc_id, line, low ORDER BY x0) AS nb FROM s),
 o AS (SELECT *, CASE WHEN blank THEN CASE WHEN bef IS NULL OR aft IS NULL OR aft - bef >= {keep} THEN ' ' ELSE '' END ELSE ch || CASE WHEN coalesce(nb, true) THEN '' {tabbed}WHEN nx - center >= {space} THEN ' ' ELSE '' END END AS piece FROM n),
 l AS (SELECT doc_id, line, low, string_agg(piece, '' ORDER BY x0) AS lt FROM o GROUP BY 1, 2, 3)
 SELECT doc_id, CAST(1 AS INTEGER) AS page_no, string_agg(lt, chr(10) ORDER BY line, low) AS text FROM l WHERE regexp_matches(lt, '\S') GROUP BY 1"""


query("k1_layout_uneven", lambda s, d: layout.page_texts(uneven(s, d)), uneven_sql("unit * 1.3::DOUBLE", "unit * 1.1::DOUBLE", "unit * 1.3::DOUBLE"))
query("k6_layout_uneven_fixed", lambda s, d: layout.page_texts(uneven(s, d), fixed_keep=6.0, fixed_space=5.3), uneven_sql("6.0::DOUBLE", "5.3::DOUBLE", None))
query("k3_spacing", lambda s, d: layout.spacing(layout.line_groups(uneven(s, d))).groupBy("doc_id", "line").agg(F.max("spacing").alias("spacing"), F.max("place").alias("last")), uneven_sql("1", "1", None).split(" n AS (")[0].rstrip().rstrip(",") + " SELECT doc_id, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY line, low) - 1 AS INTEGER) AS line, max(unit) AS spacing, CAST(count(*) - 1 AS INTEGER) AS last FROM s GROUP BY doc_id, line, low")

# --- outputs ----------------------------------------------------------------------------------------------------------

OUT = ("doc_id", "output", "out_ix", "page_no")
query("p1_single_outputs", on_conversations(lambda p: sinks.outputs(rows(p, LIST), p).select(*OUT)), ORACLE_SQL["f9_ordered_pages"].replace("SELECT doc_id, CAST(row_number()", "SELECT doc_id, doc_id AS output, CAST(row_number()"))
query("p2_grouped_outputs", on_conversations(lambda p: sinks.outputs(rows(p, LIST), p, "grouped").select(*OUT)), f"WITH {LIST_SQL} SELECT doc_id, doc_id || '_group0' || group_ix AS output, CAST(row_number() OVER (PARTITION BY doc_id, group_ix ORDER BY pos) AS INTEGER) AS out_ix, page_no FROM l")
query("p3_page_outputs", on_conversations(lambda p: sinks.outputs(rows(p, LIST), p, "separate").select(*OUT)), f"WITH {LIST_SQL} SELECT DISTINCT doc_id, doc_id || '_page0' || page_no AS output, CAST(1 AS INTEGER) AS out_ix, page_no FROM l")
query("p4_split_pages", on_conversations(lambda p: sinks.split_to_pages(p).select("doc_id", "page_no", "output")), f"WITH {CONVERSATIONS}, {COUNTED} SELECT doc_id, page_no, doc_id || '_page' || lpad(CAST(page_no AS VARCHAR), 2, '0') AS output FROM q WHERE n > 1")
query("p8_text_dump", on_conversations(lambda p: sinks.dumped_text(p)), f"WITH {CONVERSATIONS} SELECT doc_id, page_no, '=== ' || doc_id || ', page ' || page_no || ' ===' || chr(10) || text AS value FROM p")
query("p12_collisions", lambda s, d: sinks.without_collisions(relations.read(s, d, "documents").select(F.concat("lang", F.lit(".pdf")).alias("name"))), "SELECT lang || '.pdf' AS name, CASE WHEN i = 0 THEN lang || '.pdf' ELSE lang || '_copy_' || CASE WHEN i < 10 THEN '0' ELSE '' END || i || '.pdf' END AS final_name FROM (SELECT lang, row_number() OVER (PARTITION BY lang) - 1 AS i FROM documents)")
query("q2_pipeline", on_conversations(lambda p: PageQuery(p).query("all", group_start="contains:'la'", group_end="contains:'and'", filter_matches="contains:'the' & !contains:'ing'").rows.select("doc_id", "group_ix", "page_no")), ORACLE_SQL["h4_keep_criteria"])
query("q1_contents", on_conversations(lambda p: PageQuery(p).select("contains:'the' & !contains:'and'").contents().select("doc_id", "out_ix", "page_no", "role", F.length("text").alias("length"))), f"WITH {CONVERSATIONS} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS INTEGER) AS out_ix, page_no, role, CAST(length(text) AS INTEGER) AS length FROM p WHERE contains(text, 'the') AND NOT contains(text, 'and')")
assert set(GROUP_COLUMNS) >= {"doc_id", "group_ix"}
