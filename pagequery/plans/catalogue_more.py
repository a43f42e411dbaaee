"""More queries: table functions, streams, kept sets, outputs, names and descriptions, and what is decided when a query is planned."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequery.api import PageQuery
from pagequery.functions import names
from pagequery.operators import analysis, extract, groups, previews
from pagequery.sources import relations, sinks
from pagequery.sql import register
from pagequery.storage import shared_folder
from pagequery.streaming.documents import selection_stream

from . import template
from .catalogue import CONVERSATIONS, COUNTED, LIST, LIST_SQL, LONG, NUMBER, ORACLE_SQL, PAGE_WORDS, QUERIES, ROWS, SOURCES, on_conversations, on_sources, query, rows, section_sql
from .compact import Pick, as_compact, parse_legacy, parse_patterns

SECTIONS = "contains:'the' to contains:'and'"


def named_view(pages: DataFrame) -> str:
    name = f"pages_{uuid.uuid4().hex}"
    register(pages.sparkSession, **{name: pages})
    return name


def by_sql(call: str):
    """A query over a view of the conversations; {} is its name."""
    return on_conversations(lambda p: p.sparkSession.sql(call.format(named_view(p))))


# --- table functions and streams ----------------------------------------------------------------------------------------

query("q1_page_select", by_sql("""SELECT * FROM page_select(TABLE({}), "contains:'the',3-1,last 2")"""), ORACLE_SQL["f3_list"])
query("q2_page_select_split", by_sql("""SELECT doc_id, group_ix, page_no, spec, is_range FROM page_select(TABLE({}), 'all', group_start => "contains:'la'", group_end => "contains:'and'", dedup => true)"""), f"WITH a AS ({ORACLE_SQL['g2_split']}) SELECT doc_id, group_ix, page_no, spec, is_range FROM a")
query("l15_text_values", lambda s, d: s.sql(f"SELECT doc_id, variable, page_no, value FROM text_values(TABLE({named_view(relations.source_pages(s, d))}), 'License:wd1pg0mt-2')"), f"WITH {PAGE_WORDS}, m AS (SELECT doc_id, page_no, x, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, line, word) AS place, count(*) OVER (PARTITION BY doc_id) AS k FROM x WHERE contains(c, 'license')) SELECT doc_id, 'license' AS variable, page_no, x AS value FROM m WHERE place > k - 2")


def streamed(spark: SparkSession, sf_dir: str, expression: str) -> DataFrame:
    """The conversations read as a stream, file by file and turn by turn, to its end; a conversation is closed when all its turns are there."""
    batch = relations.read(spark, sf_dir, "conversations")
    counted = batch.groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    folder = f"{shared_folder(spark)}/pagequery-{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    # turns in any order: dealt out by a hash, so that a conversation comes in several batches
    dealt = batch.join(counted, "conv_id").withColumn("at", F.timestamp_seconds(F.lit(1000) + F.col("turn")))
    dealt.repartition(4, F.xxhash64("conv_id", "turn")).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(dealt.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in").withWatermark("at", "1 hour")
    pages = relations.page_relation(stream, F.col("conv_id"), F.col("turn") + 1, F.col("text"), F.length("text") % 3, F.col("at"), F.col("n"))
    out = selection_stream(pages, expression, "at", n_pages=F.col("n"))
    running = out.writeStream.option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out").format("parquet").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


query("n_stream_sections", lambda s, d: streamed(s, d, SECTIONS), ORACLE_SQL["e3_sections"])
query("n_stream_list", lambda s, d: streamed(s, d, LIST), ORACLE_SQL["f3_list"])

# --- kept sets ----------------------------------------------------------------------------------------------------------


def asked_twice(spark: SparkSession, sf_dir: str, first: str, again: str) -> DataFrame:
    """The second way of writing an expression, which reads what the first one kept."""
    kept = PageQuery(relations.conversation_pages(spark, sf_dir)).kept()
    before = kept.where(first).inputFiles()
    found = kept.where(again)
    if found.inputFiles() != before:
        raise AssertionError("an equal expression was computed again")
    return found


query("q6_kept_set", lambda s, d: asked_twice(s, d, "contains:'the' & !contains:'and'", "!contains:'and' & !!contains:'the'"), ORACLE_SQL["d_and_not"])
query("q6_kept_leaves", lambda s, d: asked_twice(s, d, "(contains:'la' | contains:'the') & !contains:'ing'", "!contains:'ing' & (contains:'the' | contains:'la')"), ORACLE_SQL["d_parentheses"])
query("q6_kept_sections", on_conversations(lambda p: PageQuery(p, range_pages=3).kept().where("contains:'ing' to contains:'the'")), ORACLE_SQL["e5_section_pages"])

# --- merged lists -------------------------------------------------------------------------------------------------------

query("f8_merged_lists", on_conversations(lambda p: groups.merged(rows(p, "contains:'the'"), rows(p, "2-1,last 1")).drop("preserve_order")), f"WITH {CONVERSATIONS}, {COUNTED}, a AS (SELECT doc_id, 1 AS group_ix, page_no AS pos, page_no, $$contains:'the'$$ AS spec, count(*) OVER (PARTITION BY doc_id) > 1 AS is_range FROM q WHERE contains(text, 'the')), m AS (SELECT DISTINCT doc_id FROM a), b AS (SELECT doc_id, 1 AS group_ix, -page_no AS pos, page_no, '2-1' AS spec, true AS is_range FROM q WHERE n >= 2 AND page_no <= 2 UNION ALL SELECT doc_id, 2, page_no, page_no, 'last 1', true FROM q WHERE n >= 2 AND page_no = n) SELECT doc_id, CAST(group_ix AS INTEGER) AS group_ix, pos, page_no, spec, is_range FROM a UNION ALL SELECT b.doc_id, CAST(group_ix + (m.doc_id IS NOT NULL)::INT AS INTEGER), pos, page_no, spec, is_range FROM b LEFT JOIN m ON m.doc_id = b.doc_id")

# --- decided when a query is planned ------------------------------------------------------------------------------------


def from_file(pages: DataFrame, lines: list[str]) -> DataFrame:
    """A selection by a selector file, which the driver reads."""
    with tempfile.TemporaryDirectory() as folder:
        with open(os.path.join(folder, "pages.txt"), "w", encoding="utf-8") as f:
            f.write("\n".join(lines))
        return PageQuery(pages, base_dir=folder).select("file:pages.txt").rows


query("a10_selector_file", on_conversations(lambda p: from_file(p, ["# pages", "contains:'the'  # the word", "", "3-1,last 2"])), ORACLE_SQL["f3_list"])
query("a12_quoted_expression", on_conversations(lambda p: rows(p, "\"contains:'the',3-1,last 2\"")), ORACLE_SQL["f3_list"])
query("c9_offset_unquoted", on_conversations(lambda p: rows(p, "contains:the+1").drop("spec")), f"WITH a AS ({ORACLE_SQL['c7_offset_after']}) SELECT * EXCLUDE (spec) FROM a")
query("d_bal_nested", on_conversations(lambda p: PageQuery(p).where("((contains:'la') | (contains:'the' & (!(contains:'ing'))))")), ORACLE_SQL["d_precedence"])
query("i5_default_dedup", on_conversations(lambda p: PageQuery(p).query(LIST).rows), ORACLE_SQL["i2_dedup_strict"])
query("i4_dedup_fail", on_conversations(lambda p: groups.dedup(rows(p, "1"), "fail")), ORACLE_SQL["b4_page"].replace("n >= 3 AND page_no = 3", "page_no = 1").replace("'3' AS spec", "'1' AS spec"))
query("h7_blank_filter", on_conversations(lambda p: groups.keep_groups(rows(p, LIST), p, "  ")), f"WITH {LIST_SQL} SELECT {ROWS} FROM l")
query("q5_on_error_ignore", on_conversations(lambda p: PageQuery(p, on_error="ignore").select("4,contains:'the'").rows), f"WITH {CONVERSATIONS}, {COUNTED} SELECT doc_id, CAST(1 AS INTEGER) AS group_ix, page_no AS pos, page_no, '4' AS spec, false AS is_range, true AS preserve_order FROM q WHERE page_no = 4 UNION ALL SELECT doc_id, 2, page_no, page_no, $$contains:'the'$$, count(*) OVER (PARTITION BY doc_id) > 1, true FROM q WHERE contains(text, 'the')")
query("q7_analyze", on_conversations(lambda p: PageQuery(p).analyze().groupBy("page_type").agg(F.count(F.lit(1)).alias("n"))), f"WITH a AS ({ORACLE_SQL['m2_analysis']}) SELECT page_type, count(*) AS n FROM a GROUP BY 1")
query("q7_split", on_conversations(lambda p: PageQuery(p).split_pages().select("doc_id", "page_no", "output")), ORACLE_SQL["p4_split_pages"])
query("p16_warnings", lambda s, d: analysis.warning_counts(relations.read(s, d, "documents").select(F.col("text").alias("message")), {"licence": "license", "key": "token"}), "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN contains(lower(text), 'license') THEN 'licence' WHEN contains(lower(text), 'token') THEN 'key' ELSE 'other' END AS kind FROM documents) GROUP BY 1")

# --- extraction ---------------------------------------------------------------------------------------------------------

LEGACY = [as_compact(parse_legacy(x)) for x in ("License:right:1:word", "License:left:2:text")]
query("l26_legacy_as_compact", on_sources(lambda p: extract.matches(p, LEGACY).select("doc_id", "page_no", "pattern", "line", "word", "extracted")), f"WITH {PAGE_WORDS} SELECT doc_id, page_no, CAST(0 AS INTEGER) AS pattern, CAST(line AS INTEGER) AS line, CAST(word AS INTEGER) AS word, w[least(word + 1, n - 1) + 1] AS extracted FROM x WHERE contains(c, 'license') UNION ALL SELECT doc_id, page_no, 1, CAST(line AS INTEGER), CAST(word AS INTEGER), array_to_string(w[greatest(word - 2, 0) + 1:], ' ') FROM x WHERE contains(c, 'license')")
query("l25_last_pages", on_sources(lambda p: extract.page_count_of(p, Pick("last", 3)).select("doc_id", "page_no")), f"WITH {LONG} SELECT doc_id, page_no FROM q WHERE page_no > n - 3")
query("l6_named_variables", on_sources(lambda p: extract.variables(p, parse_patterns(["License Text:wd1pg0", "Apache:wd1pg0mt-1"]))), f"WITH {PAGE_WORDS}, d AS (SELECT DISTINCT doc_id FROM p), m AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY page_no DESC, line DESC, word DESC) AS place FROM x WHERE contains(c, 'apache')), t AS (SELECT u.doc_id, u.x, row_number() OVER (PARTITION BY u.doc_id ORDER BY u.page_no, u.line, u.word) AS place FROM x v JOIN x u ON u.doc_id = v.doc_id AND u.page_no = v.page_no AND u.line = v.line AND u.word = v.word + 1 WHERE contains(v.c, 'license') AND contains(u.c, 'text')) SELECT d.doc_id, coalesce(t.x, 'No_Match') AS license_text, coalesce(m.x, 'No_Match') AS apache FROM d LEFT JOIN t ON t.doc_id = d.doc_id AND t.place = 1 LEFT JOIN m ON m.doc_id = d.doc_id AND m.place = 1")
LONG_WALKS = {
    "License:u1r1wd1": "list_filter(string_split_regex(ls[greatest(line - 1, 0) + 1], '\\s+'), lambda y: y <> '')[least(1, len(list_filter(string_split_regex(ls[greatest(line - 1, 0) + 1], '\\s+'), lambda y: y <> '')) - 1) + 1]",
    "License:r1d1wd2": "CASE WHEN regexp_matches(ls[least(line + 1, len(ls) - 1) + 1], '\\S') THEN array_to_string(list_filter(string_split_regex(ls[least(line + 1, len(ls) - 1) + 1], '\\s+'), lambda y: y <> '')[1:2], ' ') END",
    "License:ln0": "array_to_string(ls[line + 1:], chr(10))",
    "License:ln2-": "array_to_string(list_filter(ls[line + 1:line + 2], lambda y: regexp_matches(y, '\\S')), chr(10))",
    "License:nb1-": f"nullif(regexp_extract(array_to_string(w[word + 1:], ' ') || ' ' || array_to_string(ls[line + 2:], ' '), {NUMBER}), '')",
}
query("l10_chained_walks", on_sources(lambda p: extract.matches(p, parse_patterns([f"v{i}={x}" for i, x in enumerate(LONG_WALKS)])).select("doc_id", "page_no", "pattern", "line", "word", "extracted")), f"WITH {PAGE_WORDS} " + " UNION ALL ".join(f"SELECT doc_id, page_no, CAST({i} AS INTEGER) AS pattern, CAST(line AS INTEGER) AS line, CAST(word AS INTEGER) AS word, {sql} AS extracted FROM x WHERE contains(c, 'license')" for i, sql in enumerate(LONG_WALKS.values())))

# --- names and outputs --------------------------------------------------------------------------------------------------

ARGUMENTS = ["contains:'a' & contains:'b'", "file:lists/mine.txt", "4-6", "odd"]
query("o18_descriptions", on_conversations(lambda p: relations.document_info(p).select("doc_id", names.selection_description(ARGUMENTS, F.col("page_count")).alias("many"), names.selection_description(["1-3", "odd"], F.col("page_count")).alias("few"))), f"WITH {CONVERSATIONS} SELECT doc_id, 'mixed_4args_1files-1patterns_' || max(page_no) || 'pg' AS many, 'pages1-3, odd_pages' AS few FROM p GROUP BY 1")
query("o23_query_descriptions", on_conversations(lambda p: relations.document_info(p).select("doc_id", F.concat(F.lit(template.query_description("all", "contains:'la'", "contains:'and'", "1-2", 3)), F.lit("-"), F.col("page_count").cast("string")).alias("value"))), f"WITH {CONVERSATIONS} SELECT doc_id, 'all-bounded-filtered-3groups-' || max(page_no) AS value FROM p GROUP BY 1")


def url_language():
    return F.nullif(F.regexp_extract("url", "://[^/]*/([a-z]+)/", 1), F.lit(""))


SQL_LANGUAGE = "nullif(regexp_extract(url, '://[^/]*/([a-z]+)/', 1), '')"
query("o28_fallbacks", lambda s, d: relations.read(s, d, "pages").select("page_id", names.fill_template("{lang|any}-{other|none}-{third}", {"lang": url_language()}).alias("value")), f"SELECT page_id, coalesce({SQL_LANGUAGE}, 'any') || '-none-NO-THIRD' AS value FROM pages")
query("o14_default_template", lambda s, d: relations.read(s, d, "pages").select("page_id", names.template_name(template.default_template([template.variable_name("Lang code")]), {"lang_code": url_language()}, F.lit("x"), F.lit("1-2")).alias("value")), f"SELECT page_id, coalesce({SQL_LANGUAGE}, 'NO-LANG-CODE') || '_pages1-2.pdf' AS value FROM pages".replace("NO-LANG-CODE", "NO-LANG_CODE"))


def url_previews(spark: SparkSession, sf_dir: str, preview: bool = True) -> DataFrame:
    pages = relations.read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/]*)", 1).alias("host"), url_language().alias("lang"))
    return previews.previews(pages, "{lang}-p{page_id}", F.lit("x"), F.lit("1"), preview=preview)


HOSTS = f"h AS (SELECT page_id, regexp_extract(url, '://([^/]*)', 1) AS host, {SQL_LANGUAGE} AS lang FROM pages)"
query("o29_previews", lambda s, d: url_previews(s, d).select("page_id", "name", F.array_join("problems", ";").alias("problems")), f"WITH {HOSTS} SELECT page_id, coalesce(lang, 'PREVIEW_LANG') || '-p' || page_id || '.pdf' AS name, CASE WHEN lang IS NULL THEN 'lang was not found' ELSE '' END AS problems FROM h")
query("o29_names", lambda s, d: url_previews(s, d, False).select("page_id", "name"), f"WITH {HOSTS} SELECT page_id, coalesce(lang, 'NO_LANG') || '-p' || page_id || '.pdf' AS name FROM h")
query("o33_batches", lambda s, d: previews.batch_summary(url_previews(s, d), "host", "page_id").select("batch", "n", "failed", F.coalesce(F.try_element_at("reasons", F.lit("lang was not found")), F.lit(0)).alias("without_lang"), F.coalesce(F.array_join(F.transform("first_failures", lambda x: x["order"].cast("string")), ","), F.lit("")).alias("first")), f"WITH {HOSTS}, r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY lang IS NOT NULL, page_id) AS place FROM h) SELECT host AS batch, count(*) AS n, count(*) FILTER (WHERE lang IS NULL) AS failed, count(*) FILTER (WHERE lang IS NULL) AS without_lang, coalesce(string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY page_id) FILTER (WHERE lang IS NULL AND place <= 10), '') AS first FROM r GROUP BY 1")
query("p10_decisions", lambda s, d: sinks.decided(relations.read(s, d, "customer").select(F.concat(F.lit("c"), (F.col("c_custkey") % 500).cast("string")).alias("name")).distinct(), relations.read(s, d, "nation").select(F.concat(F.lit("C"), F.col("n_nationkey").cast("string")).alias("name")).unionByName(relations.read(s, d, "region").select(F.concat(F.lit("c"), F.col("r_regionkey").cast("string"), F.lit("_1")).alias("name"))), "rename"), "WITH c AS (SELECT DISTINCT c_custkey % 500 AS k FROM customer) SELECT 'c' || k AS name, CASE WHEN n_nationkey IS NULL THEN 'create' ELSE 'rename' END AS action, CASE WHEN n_nationkey IS NULL THEN 'c' || k WHEN r_regionkey IS NULL THEN 'c' || k || '_1' ELSE 'c' || k || '_2' END AS final_name FROM c LEFT JOIN nation ON n_nationkey = k LEFT JOIN region ON r_regionkey = k")


def written_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs by document, written, and written again for half of the documents under names that are free: what the folder then holds."""
    pages = relations.conversation_pages(spark, sf_dir)
    path = f"{shared_folder(spark)}/pagequery-{spark.sparkContext.applicationId}/outputs-{uuid.uuid4().hex}"
    out = sinks.outputs(rows(pages, "first 2"), pages).withColumn("output", F.concat(F.lit("d"), F.right(F.col("doc_id"), F.lit(1)))).select("output", "doc_id", "page_no")
    sinks.write_outputs(out, path)
    sinks.write_outputs(out.where(F.col("output").isin("d0", "d2", "d4")), path, "rename")
    sinks.write_outputs(out.where(F.col("output").isin("d0", "d1")).limit(0), path, "overwrite")
    return spark.read.schema("page_no int, output string").parquet(path).groupBy("output").agg(F.count(F.lit(1)).alias("n"))


query("p9_written_outputs", written_twice, f"WITH {CONVERSATIONS}, o AS (SELECT 'd' || right(doc_id, 1) AS output FROM p WHERE page_no <= 2) SELECT output, count(*) AS n FROM o GROUP BY 1 UNION ALL SELECT output || '_1', count(*) FROM o WHERE output IN ('d0', 'd2', 'd4') GROUP BY 1")


def dumped_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/pagequery-{spark.sparkContext.applicationId}/dump-{uuid.uuid4().hex}"
    sinks.dump_text(relations.conversation_pages(spark, sf_dir), path)
    return relations.read_dump(spark, path).select("doc_id", "page_no", F.md5(F.col("text").cast("binary")).alias("text"), "size_bytes")


query("a2_read_dump", dumped_and_read, f"WITH {CONVERSATIONS} SELECT doc_id, page_no, md5(text) AS text, size_bytes FROM p")
query("e6_sections_to_offset_ranges", on_sources(lambda p: PageQuery(p, range_pages=40).select("contains:'License' to contains:'License'+1").rows.groupBy("doc_id").agg(F.countDistinct("group_ix").alias("n"))), f"WITH {section_sql('contains(text, $$License$$)', 'coalesce(lag(contains(text, $$License$$)) OVER (PARTITION BY doc_id ORDER BY page_no), false)', SOURCES)} SELECT doc_id, count(*) AS n FROM s GROUP BY 1")
assert len(ORACLE_SQL) == len(QUERIES)
