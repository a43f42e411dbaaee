"""Fill-in-the-middle transformation as relations of units.

A text is cut into the matches of a pattern (its units: lines, each with its line feed). posexplode gives a row for each unit, of
which only the ordinal and the length go on; window running sums of the lengths place each unit's end in its text. Two cut
requests a document, by unit ordinal, are joined with these rows; an aggregate by document gathers the offsets, and substring takes prefix, middle
and suffix from the text. Units are shuffled as numbers, and each text once, to meet its offsets.

Cuts and forms are drawn from the sha256 of seed and doc_id, so they are the same in each run and on any cluster. A document is plain,
its text as it is, if the text is empty, holds a sentinel, or is drawn by ``rate``; otherwise ``spm`` per cent of the rest are suffix-prefix-middle.
``restored`` reads a transformed text back from its sentinels alone; they must not overlap one another, which is checked.

Defined results: a null or empty text has no units and is plain, and its output is empty. A text without a line feed is one unit.
Lengths and offsets are code points. Repeated rows are transformed alike, row by row, as they have one doc_id; a null doc_id counts as the empty
text in the draw. Equal cuts (ties) give an empty middle. An empty table gives an empty result. Other columns are kept by
``transformed``, but for those of the names that it adds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ROW, free_name, row_key, settled, table

LINES = r"[^\n]*\n|[^\n]+"


@dataclass(frozen=True)
class Sentinels:
    """The marks before prefix, suffix and middle."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = self.all
        clash = any(a[i:] and b.startswith(a[i:]) for a in marks for b in marks for i in range(1, len(a)))
        if not all(marks) or clash or any(a != b and a in b for a in marks for b in marks) or len(set(marks)) < 3:
            raise ValueError(f"sentinels {marks} are empty or overlap, so that texts could not be restored")

    @property
    def all(self) -> tuple[str, str, str]:
        return (self.prefix, self.suffix, self.middle)


def draws(doc_id: Column, seed: int) -> list[Column]:
    """The first four groups of eight hexadecimal digits of the sha256 of seed:doc_id, as numbers."""
    hexadecimal = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(hexadecimal, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transformed(documents: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, pattern: str = LINES, marks: Sentinels | None = None) -> DataFrame:
    """documents(doc_id, text) with n_units, form, prefix_chars, middle_chars and output."""
    marks = marks or Sentinels()
    added = ("n_units", "form", "prefix_chars", "middle_chars", "output")
    documents = settled(documents.drop(*added))
    keep = [F.col(f"`{c}`") for c in documents.columns]
    row, of, units_of, first_of, last_of = (free_name(documents, x) for x in ("__pq_row", "__pq_of", "__pq_units", "__pq_first", "__pq_last"))
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    text = F.coalesce("text", F.lit(""))
    keyed = documents.withColumn(row, row_key(documents))
    # a row for each unit: its ordinal (from 1), and where it ends
    units = keyed.select(F.col(row).alias(ROW), "doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("pos", "unit"))
    units = units.select(ROW, "doc_id", F.col("pos") + 1, F.char_length("unit").cast("long").alias("size")).toDF(ROW, "doc_id", "ordinal", "size")
    of_text = Window.partitionBy(ROW)
    ended = units.withColumn("end", F.sum("size").over(of_text.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.count(F.lit(1)).over(of_text))
    # the cut requests of a document, by ordinal (0: the text's start), joined with its units
    cuts = F.array(*(F.struct(F.lit(i).alias("cut"), (h % (F.col("n") + 1)).alias("wanted")) for i, h in enumerate((h1, h2))))
    hits = ended.withColumn("request", F.explode(cuts)).where((F.col("ordinal") == F.col("request.wanted")) | ((F.col("ordinal") == 1) & (F.col("request.wanted") == 0)))
    at = F.when(F.col("request.wanted") == 0, F.lit(0)).otherwise(F.col("end"))
    offsets = hits.groupBy(F.col(ROW).alias(of)).agg(F.max("n").cast("long").alias(units_of), F.min(at).alias(first_of), F.max(at).alias(last_of))
    made = keyed.join(offsets, F.col(row) == F.col(of), "left")
    n, first, last = F.coalesce(units_of, F.lit(0).cast("long")), F.col(first_of), F.col(last_of)
    plain = (n == 0) | (h3 % 100 >= rate)
    for mark in marks.all:
        plain = plain | F.contains(text, F.lit(mark))
    form = F.when(plain, "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    p, m, s = F.substring(text, F.lit(1), first.cast("int")), F.substring(text, (first + 1).cast("int"), (last - first).cast("int")), F.substring(text, (last + 1).cast("int"), F.char_length(text))
    parts = {"psm": (marks.prefix, p, marks.suffix, s, marks.middle, m), "spm": (marks.suffix, s, marks.prefix, p, marks.middle, m)}
    joined = {k: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in v)) for k, v in parts.items()}
    output = F.when(form == "plain", text).when(form == "spm", joined["spm"]).otherwise(joined["psm"])
    chars = [F.when(form != "plain", x) for x in (first, last - first)]
    return made.select(*keep, n.alias("n_units"), form.alias("form"), chars[0].alias("prefix_chars"), chars[1].alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, marks: Sentinels | None = None) -> Column:
    """The text that a transformed output was made of: its sentinels are found again."""
    marks = marks or Sentinels()

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        """What stands behind the first mark, behind the second, and behind the middle mark."""
        body = F.substring(output, F.lit(len(first) + 1), F.char_length(output))
        a = F.substring_index(body, second, 1)
        rest = F.substring(body, F.char_length(a) + len(second) + 1, F.char_length(body))
        b = F.substring_index(rest, marks.middle, 1)
        return a, b, F.substring(rest, F.char_length(b) + len(marks.middle) + 1, F.char_length(rest))

    prefix, suffix, middle = parts(marks.prefix, marks.suffix)
    suffix_, prefix_, middle_ = parts(marks.suffix, marks.prefix)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_, middle_, suffix_)).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transformed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


QUERIES = {"op11_fill_in_middle": op11_fill_in_middle}
ORACLE_SQL = {
    "op11_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
             u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS l, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2,
                          CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
             c AS (SELECT *, CAST(len(l) AS BIGINT) AS n, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS a, greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS b,
                          CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                               WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
             p AS (SELECT *, array_to_string(l[1:a], '') AS p, array_to_string(l[a + 1:b], '') AS m, array_to_string(l[b + 1:], '') AS s FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(t) AS restored_sha256 FROM p"""
}
