"""Alignment of two tokenizers over the same bytes, by elementary intervals.

Both tokenizers' tokens cut the bytes of space + text into ranges. The union of both arrays of ends (``union1d``) gives the elementary
intervals, none of which holds an end inside, so each is one overlap of one A token with one B token; ``searchsorted`` of the
intervals in each array names these owners. Where both have an end, a group closes. Within a group every A token is linked to every
B token; products are taken over the group's distinct ids with their multiplicities, so a long group of repeated tokens is small.

A text is encoded and aligned by segments (``byte_bpe.segments``), at whose borders both tokenizers have an end: no pre-token of A spans
them, and no piece of B goes on after a space or holds a line feed with anything else, which is checked when the vocabulary is
loaded. Short segments are aligned once a worker and kept in tables of bounded size, so running text costs a lookup a word.

A pair's count is the number of documents that hold it linked. Each document's distinct pairs are stored once, with how often they are linked;
counts are a sum over them with partial sums on the map side. The ``most`` most frequent pairs, a bounded number, go to all tasks with their counts;
pairs beyond these, which are rare and so no hot keys, meet their counts by a join, and both parts are added.

Defined results: null or empty texts, and texts whose tokens' bytes in A or B are not those of space + text (a literal U+2581), have
no tokens: zeros, and '' for the digest. Repeated rows are documents of their own and count as such. Ties in the count of an A id's best pair are all best.
A null doc_id is kept. Texts of any length are read whole. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right as bisect
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import segments, slices
from .common import ROW, release_memory, stored, table

BYTE, PIECE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself where it can be printed, else the next one from U+0100."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return {chr(b if b in printed else next(others)): b for b in range(256)}


@dataclass
class Encoder:
    """A side: many segments to ids, and the bytes of each id."""

    ids: callable
    tokens: list[bytes]


def byte_side(path: str) -> Encoder:
    """A byte-level BPE of the tokenizers library; special tokens' strings are plain text."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    back = byte_of_character()
    tokens = [b""] * made.get_vocab_size()
    for token, i in made.get_vocab(with_added_tokens=False).items():
        tokens[i] = bytes(map(back.__getitem__, token))
    return Encoder(lambda parts: [e.ids for e in made.encode_batch_fast(parts, add_special_tokens=False)], tokens)


def piece_side(path: str) -> Encoder:
    """A sentencepiece model that sets a space before a text; segments that do not begin with a space are read behind a line feed."""
    import sentencepiece

    made = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [made.id_to_piece(i) for i in range(made.get_piece_size())]
    if any("▁" in p.lstrip("▁") or ("\n" in p and p != "\n") for p in pieces):
        raise ValueError(f"{path}: pieces go on after a space or a line feed, so texts cannot be cut there")
    tokens = [bytes([int(p[3:5], 16)]) if made.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    lead = len(made.encode("\n"))

    def ids(parts: list[str]) -> list[list[int]]:
        read = made.encode([p[1:] if p[:1] == " " else "\n" + p for p in parts], num_threads=1)
        return [i if p[:1] == " " else i[lead:] for p, i in zip(parts, read, strict=True)]

    return Encoder(ids, tokens)


def products(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs (A id << 32 | B id) linked within groups, how often, and their groups: the products of each group's distinct ids, expanded."""

    def distinct(ids: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        both, n = np.unique(group << 32 | ids, return_counts=True)
        return both >> 32, both & 0xFFFFFFFF, n

    ga, ia, na = distinct(a, group_a)
    gb, ib, nb = distinct(b, group_b)
    groups = int(group_a[-1]) + 1
    per_b, first_b = np.bincount(gb, minlength=groups), np.searchsorted(gb, np.arange(groups))
    times = per_b[ga]  # each distinct A id of a group meets as many
    left = np.repeat(np.arange(len(ga)), times)
    right = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times) + first_b[ga[left]]
    return ia[left] << 32 | ib[right], na[left] * nb[right], ga[left]


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each elementary interval the A token and the B token that it is the overlap of, and the number of its group."""
    edges = np.union1d(ends_a, ends_b)
    owner_a, owner_b = np.searchsorted(ends_a, edges), np.searchsorted(ends_b, edges)
    shared = (ends_a[owner_a] == edges) & (ends_b[owner_b] == edges)
    return owner_a, owner_b, np.cumsum(shared) - shared


@dataclass
class Aligned:
    """Of a run of segments: numbers of tokens, groups and links (a row each), the groups as text, and pairs with how often they are linked, up to each end."""

    facts: np.ndarray
    texts: list[str]
    pairs: np.ndarray
    times: np.ndarray
    ends: np.ndarray


def align(a: list[list[int]], b: list[list[int]], size_a: np.ndarray, size_b: np.ndarray) -> Aligned:
    """The ids of segments by both sides, over the same bytes each and none empty; size: the bytes of each id."""
    n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    ids_a, ids_b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a, n_a), (b, n_b)))
    if not len(ids_a):
        return Aligned(np.zeros((0, 4), np.int64), [], ids_a, ids_a, ids_a)
    owner_a, owner_b, group = overlaps(np.cumsum(size_a[ids_a]), np.cumsum(size_b[ids_b]))
    of_a, of_b = np.empty(len(ids_a), np.int64), np.empty(len(ids_b), np.int64)
    of_a[owner_a], of_b[owner_b] = group, group
    pairs, times, of_pair = products(ids_a, ids_b, of_a, of_b)
    last = of_a[np.cumsum(n_a) - 1] + 1  # the groups up to each segment's end
    ends = np.searchsorted(of_pair, last)
    n_links = np.diff(np.concatenate([[0], np.cumsum(times)])[ends], prepend=0)
    cut_a, cut_b = (np.searchsorted(x, np.arange(int(group[-1]) + 2)).tolist() for x in (of_a, of_b))
    text_a, text_b = [*map(str, ids_a.tolist())], [*map(str, ids_b.tolist())]
    texts = [f"{text_a[s] if e - s == 1 else ','.join(text_a[s:e])}|{text_b[t] if f - t == 1 else ','.join(text_b[t:f])}" for s, e, t, f in zip(cut_a, cut_a[1:], cut_b, cut_b[1:], strict=False)]
    stops = last.tolist()
    return Aligned(np.stack([n_a, n_b, np.diff(last, prepend=0), n_links], 1), [";".join(texts[s:e]) for s, e in zip([0, *stops], stops, strict=False)], pairs, times, ends)


def grown(array: np.ndarray, n: int) -> np.ndarray:
    if n <= len(array):
        return array
    out = np.zeros((max(n, 2 * len(array)), *array.shape[1:]), array.dtype)
    out[: len(array)] = array
    return out


class Aligner:
    """Aligns texts by their segments; what short ones give is kept, in arrays by segment number. Pairs are numbered as they are met."""

    def __init__(self, a: Encoder, b: Encoder, segments_kept: int = 500_000, longest: int = 64):
        self.a, self.b, self.most, self.longest = a, b, segments_kept, longest
        self.size_a, self.size_b = (np.array([len(t) for t in e.tokens]) for e in (a, b))
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.texts: list[str] = []
        self.facts = np.zeros((1 << 10, 4), np.int32)  # n_a, n_b, n_groups, n_links; n_a is -1 where the bytes differ
        self.start = np.zeros(1 << 10, np.int64)
        self.pairs, self.times = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)
        self.known = np.zeros(0, np.int64)  # the pairs by number
        self.sorted, self.order = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def numbered(self, pairs: np.ndarray) -> np.ndarray:
        """The pairs' numbers."""
        at = np.searchsorted(self.sorted, pairs)
        new = np.unique(pairs[self.sorted[np.minimum(at, len(self.sorted) - 1)] != pairs] if len(self.sorted) else pairs)
        if len(new):
            self.known = np.concatenate([self.known, new])
            self.order = np.argsort(self.known, kind="stable").astype(np.int32)
            self.sorted = self.known[self.order]
            at = np.searchsorted(self.sorted, pairs)
        return self.order[at]

    def learn(self, new: list[str]) -> None:
        """Adds segments: all of them are encoded and aligned together."""
        a, b = self.a.ids(new), self.b.ids(new)
        token_a, token_b = self.a.tokens.__getitem__, self.b.tokens.__getitem__
        same = [b"".join(map(token_a, x)) == s.encode() == b"".join(map(token_b, y)) for s, x, y in zip(new, a, b, strict=True)]
        made = align([*compress(a, same)], [*compress(b, same)], self.size_a, self.size_b)
        n, used = len(self.texts), int(self.start[len(self.texts)])
        ok = np.array(same, bool)
        self.facts, self.start = grown(self.facts, n + len(new)), grown(self.start, n + len(new) + 1)
        self.pairs, self.times = grown(self.pairs, used + len(made.pairs)), grown(self.times, used + len(made.pairs))
        self.facts[n : n + len(new)] = (-1, 0, 0, 0)  # where the bytes differ
        self.facts[n : n + len(new)][ok] = made.facts
        self.start[n + 1 : n + 1 + len(new)] = used + np.concatenate([[0], made.ends])[np.cumsum(ok)]
        self.pairs[used : used + len(made.pairs)], self.times[used : used + len(made.pairs)] = self.numbered(made.pairs), made.times
        texts = iter(made.texts)
        self.texts += [next(texts) if x else "" for x in same]
        self.numbers.update(zip(new, range(n, n + len(new)), strict=True))

    def __call__(self, texts: list[str | None]) -> dict[str, list]:
        """n_a, n_b, n_groups, n_links, groups_sha256, pairs and times (arrays) of each text."""
        parts = [segments(" " + t) if t else [] for t in texts]
        if len(self.numbers) > self.most:
            self.clear()
            release_memory()
        numbers, flat = self.numbers, [*chain.from_iterable(parts)]
        new = sorted(set(flat).difference(numbers), key=len)  # long ones come last, and go after this call
        first_long = bisect(new, self.longest, key=len)
        keep = len(numbers) + first_long
        for some in (new[:first_long], new[first_long:]):
            for i in range(0, len(some), 4096):
                self.learn(some[i : i + 4096])
        codes = np.fromiter(map(numbers.__getitem__, flat), np.int64, len(flat))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(sizes).tolist()
        doc = np.repeat(np.arange(len(texts)), sizes)
        facts = np.zeros((len(texts), 4), np.int64)
        wrong = np.bincount(doc, self.facts[codes, 0] < 0, len(texts)) > 0
        for k in range(4):
            facts[:, k] = np.where(wrong, 0, np.bincount(doc, self.facts[codes, k], len(texts))).astype(np.int64)
        text_of, listed = self.texts.__getitem__, codes.tolist()
        digest = [hashlib.sha256(";".join(map(text_of, listed[e - len(p) : e])).encode()).hexdigest() if p and not w else "" for p, e, w in zip(parts, ends, wrong.tolist(), strict=True)]
        pairs, times = self.linked(np.where(wrong[doc], -1, codes), doc, len(texts))
        for s in new[first_long:]:
            del numbers[s]
        del self.texts[keep:]
        return {"n_a": facts[:, 0], "n_b": facts[:, 1], "n_groups": facts[:, 2], "n_links": facts[:, 3], "groups_sha256": digest, "pairs": pairs, "times": times}

    def linked(self, codes: np.ndarray, doc: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
        """Each document's distinct pairs, and how often they are linked, as lists."""
        doc, codes = doc[codes >= 0], codes[codes >= 0]
        width = max(len(self.texts), 1)
        both, often = np.unique(doc * width + codes, return_counts=True)  # a document's distinct segments
        doc, codes = both // width, both % width
        size = self.start[codes + 1] - self.start[codes]
        at = np.repeat(self.start[codes] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        key, times = np.repeat(doc, size) * len(self.known) + self.pairs[at], self.times[at] * np.repeat(often, size)
        low = 62 - int(n * max(len(self.known), 1)).bit_length()  # bits for how often, below those for document and pair
        if len(times) and times.max() >= 1 << max(low, 0):
            order = np.argsort(key, kind="stable")
            key, times = key[order], times[order]
        else:  # one sort of plain numbers
            both = np.sort(key << low | times)
            key, times = both >> low, both & ((1 << low) - 1)
        first = np.nonzero(np.append(True, key[1:] != key[:-1]))[0] if len(key) else np.zeros(0, np.int64)
        times, key = np.add.reduceat(times, first) if len(first) else times, key[first]
        offsets = pa.array(np.searchsorted(key, np.arange(n + 1) * len(self.known)), pa.int32())
        pairs = self.known[key % len(self.known)] if len(key) else key
        return pa.ListArray.from_arrays(offsets, pa.array(pairs, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64()))


@lru_cache(maxsize=2)
def aligner_of(byte_path: str, piece_path: str) -> Aligner:
    """One a Python process: tasks that follow one another keep what is aligned."""
    return Aligner(byte_side(byte_path), piece_side(piece_path))


FACTS = ("n_a", "n_b", "n_groups", "n_links")


def links_of(documents: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs (distinct, A id << 32 | B id), times for each row of documents(doc_id, text)."""

    def run(batches):
        aligner = aligner_of(byte_path, piece_path)
        for batch in batches:
            for part, texts in slices(batch, "text", 1 << 21):
                made = aligner(texts)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(made[k], pa.int64()) for k in FACTS), pa.array(made["groups_sha256"], pa.string()), made["pairs"], made["times"]], ["doc_id", *FACTS, "groups_sha256", "pairs", "times"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>")


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked), best (whether that is the most of its A id) of links(pairs)."""
    counts = stored(links.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pairs")
    a = F.shiftright("pair", 32)
    top = counts.groupBy(a.alias("a")).agg(F.max("n").alias("top"))
    return counts.withColumn("a", a).join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def align_tokenizers(documents: DataFrame, byte_path: str | None = None, piece_path: str | None = None, most: int = 1_000_000) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of documents(doc_id, text).

    most: how many pairs at most go to every task (17 bytes each)."""
    import public_tokenizers

    spark = documents.sparkSession
    links = stored(links_of(documents, byte_path or public_tokenizers.path(BYTE), piece_path or public_tokenizers.path(PIECE)), "links")
    counts = stored(pair_counts(links), "counts")
    total = counts.count()
    hot = counts.orderBy(F.desc("n"), "pair").limit(most) if total > most else counts
    found = hot.toPandas().sort_values("pair")
    table_ = spark.sparkContext.broadcast(tuple(found[k].to_numpy() for k in ("pair", "n", "best")))
    facts = ["doc_id", *FACTS, "groups_sha256"]

    def weigh(batches):
        pairs, n, best = table_.value
        for batch in batches:
            lists = batch.column("pairs")
            values, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy()
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            doc = np.repeat(np.arange(len(batch)), np.diff(offsets))
            at = np.minimum(np.searchsorted(pairs, values), max(len(pairs) - 1, 0))
            known = pairs[at] == values if len(pairs) else np.zeros(len(values), bool)
            at = at[known]
            sums = []
            for weight in (best, n):
                total = np.zeros(len(batch), np.int64)
                np.add.at(total, doc[known], times[known] * (weight[at].astype(np.int64) if len(at) else 0))
                sums.append(pa.array(total))
            rest = np.bincount(doc[~known], minlength=len(batch))
            cut = pa.array(np.concatenate([[0], np.cumsum(rest)]), pa.int32())
            kept = [batch.column(k) for k in batch.schema.names if k not in ("pairs", "times")]
            yield pa.RecordBatch.from_arrays([*kept, *sums, *(pa.ListArray.from_arrays(cut, pa.array(x[~known])) for x in (values, times))], [*(k for k in batch.schema.names if k not in ("pairs", "times")), "n_best", "count_sum", "pairs", "times"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in links.schema if f.name in facts)
    if total <= most:
        return links.select(*facts, "pairs", "times").mapInArrow(weigh, f"{kinds}, n_best long, count_sum long, pairs array<long>, times array<long>").select(*facts, "n_best", "count_sum")
    from .common import KEY, row_key

    keyed = links.select(row_key(links).alias(ROW), *facts, "pairs", "times")
    weighed = stored(keyed.mapInArrow(weigh, f"{ROW} {KEY}, {kinds}, n_best long, count_sum long, pairs array<long>, times array<long>"), "weighed")
    rest = weighed.select(ROW, F.explode(F.arrays_zip("pairs", "times")).alias("z")).select(ROW, F.col("z.pairs").alias("pair"), F.col("z.times").alias("times"))
    rare = counts.join(hot.select("pair"), "pair", "left_anti")
    more = rest.join(rare, "pair").groupBy(F.col(ROW).alias("__pq_of")).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    out = weighed.drop("pairs", "times").join(more, F.col(ROW) == F.col("__pq_of"), "left")
    return out.select(*facts, (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", *FACTS, "n_best", "count_sum", "groups_sha256")
    return align_tokenizers(table(spark, sf_dir, "documents")).select(*columns)


QUERIES = {"op12_tokenizer_alignment": op12_tokenizer_alignment}
ORACLE_SQL: dict[str, str] = {}
