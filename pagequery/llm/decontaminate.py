"""Benchmark decontamination with spaced seeds.

A seed is a window of tokens seen through a fixed mask: some places count, the others are ignored, so a hit survives a word that
was exchanged at an ignored place. Windows of all benchmark items are hashed under every mask, and so is every window of every
document; equal hashes are hits. Around a hit the words of the document and of the item are compared place by place, in the
window and ``reach`` words to either side. Places that agree on one alignment (document place minus item place, give or take
``SHIFT`` for words put in or left out) are gathered over all hits, so scattered common phrases never add up. An item of which ``least``
of the words, or ``run`` words of any number, agree on one alignment is contained in the document.

Items shorter than the longest mask have masks of their own, of their whole length with one place left out each (items of three
words or fewer: with none).

Only built-in functions: windows are made by a generator and joined within one stage of generated code, and only hits leave it.
The benchmark is cut into pieces of ``PIECE`` places and these into blocks of at most twice ``block_seeds`` seeds, which is checked;
each block is broadcast and costs one pass over the documents. A benchmark of more than ``passes`` blocks is joined by a shuffle of
seeds instead, with the same result. A word or passage that fills the corpus only makes more hits, which are summed by
(document, item, alignment, place) before they move.

Tokens: runs of letters and digits, lower-cased. Defined results: null or empty texts and items (or such without a token) are in
no pair. Repeated rows of either table give pairs of their own, ties do not arise. Empty tables give an empty result. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, numbered, settled, stored, table, without

#: 1: the word counts; 0: it is ignored. Two masks that share no place pattern when shifted, and one that skips every second word.
MASKS = ("11011011", "11101001011", "1010101011")


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def seed(words: Column, at: Column, mask: str) -> Column:
    """The hash of the window at the place at (from 0); null where it does not fit."""
    kept = [F.get(words, at + i) for i, c in enumerate(mask) if c == "1"]
    return F.when(at + len(mask) <= F.size(words), F.xxhash64(F.lit(mask), *kept))


PIECE, BAND, SHIFT = 256, 4, 2
WIDEST = max(map(len, MASKS))


def masks_of(n: int) -> list[str]:
    """The masks of items of n words that are shorter than the longest mask."""
    return ["1" * n] if n <= 3 else ["1" * i + "0" + "1" * (n - 1 - i) for i in range(n)]


def item_pieces(benchmark: DataFrame, shortest: int, reach: int) -> DataFrame:
    """item_row, piece, item_id, n_words, low (where item_words begin in the item), item_words: a piece's words and those around it."""
    items = numbered(benchmark, "item_id", words_of(F.col("text")).alias("w")).where(F.size("w") >= shortest)
    items = items.select(F.col(ROW).alias("item_row"), "item_id", "w", F.size("w").alias("n_words"))
    pieces = items.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_words") - 1) / PIECE).cast("int"))).alias("piece"))
    margin = reach + WIDEST
    low = F.greatest(F.lit(0), F.col("piece") * PIECE - margin)
    return pieces.select("item_row", "piece", "item_id", "n_words", low.alias("low"), F.slice("w", low + 1, F.lit(PIECE + 2 * margin)).alias("item_words"))


def piece_seeds(pieces: DataFrame, lengths: list[int]) -> DataFrame:
    """seed, item_row, piece, item_at: the seeds of windows that begin in a piece."""
    last = F.least(F.col("n_words"), (F.col("piece") + 1) * PIECE) - 1
    at = pieces.select("*", F.explode(F.sequence(F.col("piece") * PIECE, last)).alias("item_at"))
    local = F.col("item_at") - F.col("low")
    made = [seed(F.col("item_words"), local, m) for m in MASKS]
    made += [F.when(F.col("n_words") == n, seed(F.col("item_words"), local, m)) for n in lengths for m in masks_of(n)]
    return at.select(F.explode(F.array(*made)).alias("seed"), "item_row", "piece", "item_at").where(F.col("seed").isNotNull())


def document_seeds(df: DataFrame, lengths: list[int], keep: list[str]) -> DataFrame:
    """A row (keep, at, seed) for each window of the column words under each mask."""
    places = df.select("*", F.explode(F.sequence(F.lit(0), F.size("words") - 1)).alias("at"))
    masks = [*MASKS, *(m for n in lengths for m in masks_of(n))]
    made = places.select(*keep, "at", F.explode(F.array(*[seed(F.col("words"), F.col("at"), m) for m in masks])).alias("seed"))
    return made.where(F.col("seed").isNotNull())


def agreeing(hits: DataFrame, reach: int) -> DataFrame:
    """row, doc_id, item_row, item_id, n_words, apart (the alignment), place: the places of the item that agree around each hit.

    The words around a hit are cut out by a generator, which no projection is merged through: the whole text stays within the generated code
    of the join, and no row that leaves it is longer than a window."""
    keys = (ROW, "doc_id", "item_row", "item_id", "n_words")
    first = F.greatest(F.col("at") - reach, F.lit(0))
    around = F.struct(F.slice("words", first + 1, F.lit(WIDEST + 2 * reach)).alias("words"), F.slice("item_words", F.greatest(F.col("item_at") - reach, F.lit(0)) - F.col("low") + 1, F.lit(WIDEST + 2 * reach)).alias("item_words"))
    near = hits.select(*keys, "at", "item_at", F.explode(F.array(around)).alias("near"))
    low = F.greatest(F.lit(-reach), -F.col("at"), -F.col("item_at"))
    places = F.sequence(low, F.lit(WIDEST + reach - 1))
    word = F.get("near.words", F.col("at") + F.col("i") - first)
    item_word = F.get("near.item_words", F.least(F.col("item_at"), F.lit(reach)) + F.col("i"))
    near = near.select("*", F.explode(places).alias("i")).where(word == item_word)
    return near.select(*keys, (F.col("at") - F.col("item_at")).alias("apart"), (F.col("item_at") + F.col("i")).alias("place"))


def contained(documents: DataFrame, benchmark: DataFrame, least: float = 0.5, run: int = 25, shortest: int = 1, reach: int = 8, block_seeds: int = 400_000, passes: int = 8) -> DataFrame:
    """row, doc_id, item_id, n_words (of the item), n_matched: a row for each document and item that it contains. documents is settled."""
    pieces = stored(item_pieces(settled(benchmark), shortest, reach), "items")
    lengths = sorted(r[0] for r in pieces.where(F.col("n_words") < WIDEST).select("n_words").distinct().collect())
    each = F.least(F.lit(PIECE), F.col("n_words") - F.col("piece") * PIECE) * (len(MASKS) + F.when(F.col("n_words") < WIDEST, F.col("n_words")).otherwise(0))
    total, n_pieces = pieces.agg(F.coalesce(F.sum(each), F.lit(0)), F.count(F.lit(1))).first()
    blocks = max(1, -(-total // block_seeds))
    block = lambda n: F.pmod(F.xxhash64("item_row", "piece"), F.lit(n))
    while 1 < blocks <= passes and blocks < n_pieces and pieces.groupBy(block(blocks)).agg(F.sum(each).alias("n")).agg(F.max("n")).first()[0] > 2 * block_seeds:
        blocks += 1
    df = numbered(documents, "doc_id", words_of(F.col("text")).alias("words")).where(F.size("words") >= shortest)
    found = None
    if blocks > passes:
        hits = document_seeds(df, lengths, [ROW]).join(piece_seeds(pieces, lengths), "seed").select(ROW, "at", "item_row", "piece", "item_at").distinct()
        found = agreeing(hits.join(pieces, ["item_row", "piece"]).join(df, ROW), reach)
    else:
        windows = document_seeds(df, lengths, ["words", ROW, "doc_id"])
        for i in range(blocks):
            mine = pieces.where(block(blocks) == i)
            hits = windows.join(F.broadcast(piece_seeds(mine, lengths)), "seed").join(F.broadcast(mine), ["item_row", "piece"])
            one = agreeing(hits, reach)
            found = one if found is None else found.unionByName(one)
    keys = (ROW, "doc_id", "item_row", "item_id", "n_words")
    # two alignments within SHIFT of one another share a band of the first kind or of the second
    bands = F.array(*(F.struct(F.lit(k).alias("kind"), F.floor((F.col("apart") + k * SHIFT) / BAND).alias("number")) for k in (0, 1)))
    of_band = found.distinct().select(*keys, "place", F.explode(bands).alias("band")).distinct()
    matched = of_band.groupBy(*keys, "band").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.max("n").alias("n_matched"))
    return matched.where((F.col("n_matched") >= least * F.col("n_words")) | (F.col("n_matched") >= run)).select(ROW, "doc_id", "item_id", "n_words", "n_matched")


def decontaminated(documents: DataFrame, benchmark: DataFrame, least: float = 0.5, short: int = 4) -> DataFrame:
    """The rows of documents that contain no item of the benchmark.

    An item of fewer than ``short`` words is in very many texts that have nothing to do with it, so it only takes documents whose words are its words."""
    documents, benchmark = settled(documents), settled(benchmark)
    found = contained(documents, benchmark, least, shortest=short).select(ROW).distinct()
    few = lambda df: numbered(df, words_of(F.col("text")).alias("words")).where(F.size("words").between(1, short - 1))
    same = few(documents).join(few(benchmark).select("words").distinct(), "words", "left_semi").select(ROW)
    return without(documents, found.unionByName(same))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contained(settled(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_words", "n_matched", F.round(F.col("n_matched") / F.col("n_words"), 6).alias("overlap"))


QUERIES = {"op7_decontamination": op7_decontamination}


def _sql(least: float = 0.5, run: int = 25, reach: int = 8) -> str:
    """The same by joining the windows' words themselves."""
    words = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"

    def windows(source: str, row: str) -> str:
        parts = []
        for n in (0, *range(1, WIDEST)):
            only = "" if n == 0 else f" AND len(w) = {n}" if source == "bp" else f" AND EXISTS (SELECT 1 FROM b WHERE len(b.w) = {n})"
            for m in masks_of(n) if n else MASKS:
                key = ", ".join(f"w[p + {i + 1}]" for i, c in enumerate(m) if c == "1")
                parts.append(f"SELECT {row}, p, '{m}' AS m, concat_ws(' ', {key}) AS k FROM {source} WHERE p + {len(m)} <= len(w){only}")
        return " UNION ALL ".join(parts)

    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
             b AS (SELECT row_number() OVER () AS i, item_id, {words} AS w FROM benchmark WHERE len({words}) > 0),
             dp AS (SELECT r, w, unnest(range(len(w))) AS p FROM d),
             bp AS (SELECT i, w, unnest(range(len(w))) AS p FROM b),
             dk AS ({windows("dp", "r")}), bk AS ({windows("bp", "i")}),
             h AS (SELECT DISTINCT r, i, dk.p AS p, bk.p AS q FROM dk JOIN bk ON dk.m = bk.m AND dk.k = bk.k),
             o AS (SELECT h.r, h.i, d.doc_id, b.item_id, d.w AS dw, b.w AS bw, p, q,
                          unnest(range(greatest(-{reach}, -p, -q), least({WIDEST + reach}, len(d.w) - p, len(b.w) - q))) AS j
                   FROM h JOIN d ON d.r = h.r JOIN b ON b.i = h.i),
             a AS (SELECT DISTINCT r, i, doc_id, item_id, len(bw) AS n_words, p - q AS apart, q + j AS place FROM o WHERE dw[p + j + 1] = bw[q + j + 1]),
             s AS (SELECT *, unnest([0, 1]) AS kind FROM a),
             n AS (SELECT r, i, doc_id, item_id, n_words, kind, CAST(floor((apart + kind * {SHIFT}) / {BAND}.0) AS INTEGER) AS band, count(DISTINCT place) AS n FROM s GROUP BY ALL),
             m AS (SELECT r, i, doc_id, item_id, n_words, max(n) AS n_matched FROM n GROUP BY ALL)
        SELECT doc_id, item_id, CAST(n_words AS INTEGER) AS n_words, n_matched, round(n_matched / n_words, 6) AS overlap
        FROM m WHERE n_matched >= {least} * n_words OR n_matched >= {run}"""


ORACLE_SQL = {"op7_decontamination": _sql()}
