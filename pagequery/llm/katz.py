"""Scores of documents under a Katz backoff model of word n-grams, learnt from the documents of the training folds.

    P_1(w)     = d(c(w)) c(w) / N, and the rest of the mass for all unseen words together
    P_k(w | h) = d_k(c(h w)) c(h w) / c(h)    where the n-gram h w is kept: it was counted at least ``kept`` times in training
               = a_k(h) P_k-1(w | h')         where h was seen, but h w is not kept (h': h without its first word)
               = P_k-1(w | h')                where h was never seen
    a_k(h)     = (1 - sum of P_k(w | h) over kept w) / (1 - sum of P_k-1(w | h') over the same w), so that P_k(. | h) adds up to one exactly

``order`` (3) is how deep the recursion goes. Words and pairs are kept from the first time they are seen, longer n-grams from the
second (``cutoff``), as is usual with Katz: what single ones had goes to backing off. An n-gram is counted no more often than its history
and than the n-gram without its first word, so only those longer n-grams are looked up of which both are frequent enough.

Discounts are Good-Turing: r* / r with r* = (r + 1) N(r + 1) / N(r) for the low counts where that is between 0 and r, and by the
log-linear fit to N(r) beyond, over all counts that are kept. Every count keeps a discount below one, so every history has mass to back off with.

How it moves. A block is ``block_tokens`` (800,000) tokens of one input partition, read once and stored as a row of word numbers and word hashes. Each block sends its distinct words and pairs, as sorted
64-bit hashes packed by difference, to buckets by hash. A bucket adds up the training counts and answers each block in the block's
own order, so that answers hold a small number an n-gram and no key; it also marks one block as the owner of each. The answers,
partitioned by block, are the model's count tables. With those of one length a block knows which longer n-grams to ask for, and
sends these in the same way. With all it scores its documents but for the backoff weights: it sums what
its own n-grams take from the mass of their histories, and asks for the weights of the histories that its documents back off from, again
as packed hashes. The sums by history give the weights, buckets answer, and a block adds them to its documents. A frequent word is spread over the buckets of its n-grams, and counts of it are one number a
block; no task holds all of any word, and what moves is distinct n-grams a block, not tokens.

Defined results: a null or empty text (or one of white space only) is its end alone. Without training documents every
probability is one. A null doc_id counts as the empty text in the fold. Repeated rows are learnt and scored as often as they occur.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
from array import array
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import BLOCK_TOKENS, U64, deflated, inflated, loosened, one_row, pair_hash, rows_of, runs_of, squeezed
from .common import discard, release_memory, release_shuffles, remainder, stored, table

END, BEGIN = 0, 1  # local ids of the end of a text, and of what stands before it


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 7)


@dataclass
class Level:
    """The distinct n-grams of one length in a block: at (which one ends at each position, or -1), hashes (sorted, but for words), and training counts once they are known."""

    at: np.ndarray
    hashes: np.ndarray
    begin: int  # the number of the history before a text
    begin_hash: int
    words: bool = False
    counts: np.ndarray | None = None
    owner: np.ndarray | None = None

    def learn(self, told: np.ndarray) -> None:
        """told: by hash, twice the count, plus one where this block is the owner."""
        if self.words:  # these are numbered as they are met
            by_hash, told = told, np.empty(len(self.hashes), np.int64)
            told[np.argsort(self.hashes)] = by_hash
        self.counts, self.owner = told >> 1, (told & 1).astype(bool)


class Block:
    """Tokens of some documents in local ids, and their distinct n-grams length by length."""

    def __init__(self, sizes: np.ndarray, tokens: np.ndarray, hashes: np.ndarray):
        self.sizes, self.tokens, self.hashes = sizes, tokens, hashes
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        self.levels = [Level(self.tokens, self.hashes, BEGIN, int(self.hashes[BEGIN]), True)]

    @classmethod
    def of(cls, texts: Iterable[bytes]) -> Block:
        """Words are numbered from the commonest on, behind the end and the beginning; those of one count by hash, which takes the least room."""
        ids: defaultdict[bytes, int] = defaultdict()
        ids.default_factory = ids.__len__  # the next free number
        ids[b" end"], ids[b" begin"]
        tokens, sizes = array("i"), array("q")
        for t in texts:  # no text's words outlive its turn
            before = len(tokens)
            tokens.extend(map(ids.__getitem__, t.split()))
            tokens.append(END)
            sizes.append(len(tokens) - before)
        hashes = np.fromiter(map(word_hash, ids), U64, len(ids))
        tokens = np.array(tokens, np.int64)
        often = np.lexsort((hashes[2:], -np.bincount(tokens, minlength=len(hashes))[2:])) + 2
        number = np.empty(len(hashes), np.int64)
        number[:2], number[often] = (END, BEGIN), np.arange(2, len(hashes))
        return cls(np.array(sizes, np.int64), number[tokens], np.concatenate([hashes[:2], hashes[often]]))

    @classmethod
    def read(cls, sizes: Iterable[int], tokens: bytes, hashes: bytes) -> Block:
        return cls(np.array(sizes, np.int64), unplaned(tokens).astype(np.int64), unpacked(hashes))

    def histories(self) -> np.ndarray:
        """For each position the n-gram of the last level that stands before it, or -1."""
        last = self.levels[-1]
        out = np.empty_like(last.at)
        out[1:] = last.at[:-1]
        out[self.starts] = last.begin
        return out

    def seen(self, history: np.ndarray, documents: int) -> np.ndarray:
        """How often each history was followed by anything in training."""
        last = self.levels[-1]
        counts = np.append(last.counts, [documents, 0])  # -1: not asked for, so below the cutoff
        if last.words:
            counts[BEGIN], counts[END] = documents, 0
        return counts[history]

    def extend(self, use: np.ndarray | None = None) -> Level:
        """Adds the next length, of the positions in use (all)."""
        last, history, words = self.levels[-1], self.histories(), self.tokens
        if use is not None:
            history, words = history[use], words[use]
        found = pair_hash(np.append(last.hashes, U64(last.begin_hash))[history], self.hashes[words])
        order = np.argsort(found)
        found = found[order]
        new = np.append(True, found[1:] != found[:-1]) if len(found) else np.zeros(0, bool)
        number = np.empty(len(found), np.int64)
        number[order] = np.cumsum(new) - 1
        at = number
        if use is not None:
            at = np.full(len(self.tokens), -1)
            at[use] = number
        hashes = found[new]
        begin_hash = int(pair_hash(np.array([last.begin_hash], U64), self.hashes[BEGIN : BEGIN + 1])[0])
        self.levels.append(Level(at, hashes, len(hashes), begin_hash))
        return self.levels[-1]

    def wanted(self, documents: int, cutoff: int) -> np.ndarray:
        """The positions whose n-gram of the next length may have been counted cutoff times."""
        last = self.levels[-1]
        own = np.append(last.counts, 0)[last.at]  # -1: not asked for, so below the cutoff
        return (own >= cutoff) & (self.seen(self.histories(), documents) >= cutoff)

    def counted(self, level: Level, train: np.ndarray) -> np.ndarray:
        """Training counts of a level's n-grams; train: a flag for each document."""
        use = np.repeat(train, self.sizes) & (level.at >= 0)
        return np.bincount(level.at[use], minlength=len(level.hashes))


def packed(hashes: np.ndarray) -> bytes:
    """Hashes as differences, byte by byte and compressed: of sorted ones the first bytes take next to nothing."""
    return deflated(np.diff(hashes, prepend=U64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes_ = np.frombuffer(inflated(data), np.uint8).reshape(8, -1)
    return np.cumsum(planes_.T.copy().view("<u8").ravel(), dtype=U64)


def by_bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket (their first bits) starts in sorted hashes."""
    edges = np.searchsorted(hashes, np.arange(1, 1 << bits, dtype=U64) << U64(64 - bits)) if bits else np.zeros(0, np.int64)
    return np.concatenate([[0], edges, [len(hashes)]])


class Discount:
    """Good-Turing discounts d(r) of counts from first on, from the numbers of types by count."""

    def __init__(self, types: dict[int, int], first: int = 1, low: int = 5):
        r = np.array(sorted(k for k in types if k >= first), float)
        n = np.array([types[int(k)] for k in r], float)
        slope = -2.0
        if len(r) >= 2:
            gaps = np.diff(np.concatenate([[0], r, [2 * r[-1] - r[-2]]]))
            z = np.log(2 * n / (gaps[:-1] + gaps[1:]))
            x = np.log(r)
            slope = float(((x - x.mean()) * (z - z.mean())).sum() / ((x - x.mean()) ** 2).sum())
        self.power = min(slope, -1.1) + 1  # r* = r (1 + 1/r)^(slope + 1)
        self.low: dict[int, float] = {}
        for k in range(first, first + low):  # Turing's own estimate as long as it is a discount, and larger for larger counts
            star = (k + 1) * types.get(k + 1, 0) / types[k] if types.get(k) else 0.0
            if not self.low.get(k - 1, 0) < star / k < 1:
                break
            self.low[k] = star / k

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        c = np.maximum(counts, 1).astype(float)
        out = (1 + 1 / c) ** self.power
        for k, d in self.low.items():
            out[counts == k] = d
        return out


class Statistics:
    """What all blocks need: totals, the discounts of each length, and from which count on it is kept."""

    def __init__(self, cutoff: int):
        self.n = self.v = self.documents = 0
        self.cutoff, self.discounts, self.unseen = cutoff, {}, 1.0

    def kept(self, length: int) -> int:
        return 1 if length <= 2 else self.cutoff

    def learn(self, length: int, types: dict[int, int]) -> None:
        self.discounts[length] = Discount(types, self.kept(length))

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.ones(len(counts))
        return np.where(counts > 0, self.discounts[1](counts) * counts / self.n, self.unseen)


REQUEST = "length int, bucket int, block long, n int, hashes binary, counts binary"
ANSWER = "block long, length int, bucket int, n int, answer binary, r array<long>, types array<long>, tokens long, ends long"
PART = "kind string, block long, ix int, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, hash long, x double, y double, kept long, seen long, data binary"
NAMES = {k: [x.split()[0] for x in v.split(", ")] for k, v in {"request": REQUEST, "answer": ANSWER, "part": PART}.items()}


def packets(block: int, length: int, hashes: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """REQUEST rows of a block's n-grams of one length, one a bucket."""
    order = np.argsort(hashes) if length == 1 else slice(None)
    h, c = hashes[order], counts[order]
    edges = by_bucket(h, bits)
    rows = [(length, i, block, e - s, packed(h[s:e]), squeezed(c[s:e])) for i, (s, e) in enumerate(zip(edges.tolist(), edges[1:].tolist(), strict=False)) if e > s]
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)], NAMES["request"])


def token_blocks(df: DataFrame, block_tokens: int) -> DataFrame:
    """block, doc_id, held_out, sizes (arrays), tokens, hashes: a row for each block of df(doc_id, held_out, text), its texts read once, as numbers of words and the words' hashes."""
    columns = ["doc_id", "held_out"]

    def run(batches):
        for block, texts, table_ in runs_of(batches, columns, block_tokens):
            release_memory()
            b = Block.of(texts)
            parts = [pa.array([b.sizes], pa.list_(pa.int64())), pa.array([planes(b.tokens, 3)], pa.binary()), pa.array([packed(b.hashes)], pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(one_row(table_, c) for c in columns), *parts], ["block", *columns, "sizes", "tokens", "hashes"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return stored(df.select(*columns, "text").mapInArrow(run, f"block long, doc_id array<{kind}>, held_out array<boolean>, sizes array<long>, tokens binary, hashes binary"), "blocks")


def requests(made: DataFrame, bits: int, order: int) -> DataFrame:
    """Distinct words and pairs of each block, with their training counts."""

    def run(batches):
        for row in rows_of(batches):
            release_memory()
            b = Block.read(row["sizes"], row["tokens"], row["hashes"])
            train = ~np.array(row["held_out"], bool)
            for length in range(1, min(order, 2) + 1):
                level = b.levels[0] if length == 1 else b.extend()
                yield packets(row["block"], length, level.hashes, b.counted(level, train), bits)

    return made.select("block", "held_out", "sizes", "tokens", "hashes").mapInArrow(run, REQUEST)


def answer(rows: pa.Table) -> pa.Table:
    """A bucket's answers: to each block twice the training count of each of its hashes, plus one where the block is the owner."""
    release_memory()
    rows = rows.sort_by("block")
    length, bucket = (rows.column(k)[0].as_py() for k in ("length", "bucket"))
    sizes = np.array(rows.column("n").to_pylist())
    hashes = np.concatenate([unpacked(x) for x in rows.column("hashes").to_pylist()])
    counts = np.concatenate([loosened(x, n) for x, n in zip(rows.column("counts").to_pylist(), sizes, strict=True)])
    order = np.argsort(hashes, kind="stable")
    starts = np.nonzero(np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]]))[0]
    totals = np.add.reduceat(counts[order], starts)
    out = np.empty(len(hashes), np.int64)
    out[order] = 2 * np.repeat(totals, np.diff(np.concatenate([starts, [len(hashes)]])))
    out[order[starts]] += 1
    answers = [squeezed(x) for x in np.split(out, np.cumsum(sizes)[:-1])]
    r, types = np.unique(totals[totals > 0], return_counts=True)
    blocks = [*rows.column("block").to_pylist(), -1]
    none = [None] * len(answers)
    ends = totals[np.nonzero(hashes[order][starts] == U64(word_hash(b" end")))[0]] if length == 1 else np.zeros(0, np.int64)
    long = pa.int64()
    columns = [pa.array(blocks, long), pa.array([length] * len(blocks), pa.int32()), pa.array([bucket] * len(blocks), pa.int32()), pa.array([*sizes.tolist(), len(totals)], pa.int32()), pa.array([*answers, None], pa.binary())]
    columns += [pa.array([*none, x.tolist()], pa.list_(long)) for x in (r, types)] + [pa.array([*none, int(x.sum())], long) for x in (totals, ends)]
    return pa.table(columns, names=NAMES["answer"])


def answered(asked: DataFrame, s: Statistics, label: str) -> DataFrame:
    """The buckets' answers as a table; s learns their totals."""
    answers = stored(asked.groupBy("length", "bucket").applyInArrow(answer, ANSWER), label)
    told = answers.where(F.col("block") == -1)
    by_r = told.select("length", F.explode(F.arrays_zip("r", "types")).alias("z")).groupBy("length", "z.r").agg(F.sum("z.types").alias("n")).collect()  # no more rows than the root of twice the tokens
    total = told.where(F.col("length") == 1).agg(F.sum("tokens"), F.sum("ends"), F.sum("n")).first()
    lengths = {r["length"] for r in by_r}
    for length in lengths or {1}:
        s.learn(length, {r["r"]: r["n"] for r in by_r if r["length"] == length})
    if total[0] is not None:
        s.n, s.documents = total[0], total[1]
        s.v = sum(r["n"] for r in by_r if r["length"] == 1)
    release_shuffles(answers.sparkSession)
    return answers


def rebuilt(b: Block, told: dict[int, np.ndarray], s: Statistics) -> Block:
    """The block with the n-grams of the lengths that answers are told of, and their counts."""
    for length in sorted(told):
        if length == 2:
            b.extend()
        elif length > 2:
            b.extend(b.wanted(s.documents, s.kept(length)))
        b.levels[-1].learn(told[length])
    return b


def scored(b: Block, s: Statistics) -> tuple:
    """The documents' sums, the histories they back off from as (document, hash) for each position, and the owned n-grams' sums as (hash, x: discounted, y: what the shorter ones give, kept and seen counts)."""
    words, tokens = b.levels[0], b.tokens
    p = s.unigram(words.counts)
    score, low = np.log10(p[tokens]), p[tokens]  # of each position, and the probability that the next length backs off to
    documents = [b.sizes, np.add.reduceat((words.counts > 0)[tokens].astype(np.int64), b.starts), np.add.reduceat(np.log10((words.counts + 1.0) / (s.n + s.v + 1.0))[tokens], b.starts)]
    backs, owned, levels = [], [], b.levels
    for length in range(2, len(levels) + 1):
        b.levels = levels[: length - 1]
        history, before, level = b.histories(), b.levels[-1], levels[length - 1]
        seen = b.seen(history, s.documents)
        told = np.append(level.counts, 0)[level.at]
        kept = told >= s.kept(length)
        d = s.discounts[length](told) if length in s.discounts else np.ones(len(told))
        place = np.full(len(level.hashes), -1)  # a position of each n-gram
        place[level.at[kept]] = np.nonzero(kept)[0]
        mine = place[level.owner & (place >= 0)]
        sums = [np.bincount(history[mine], v, len(before.hashes) + 2) for v in ((1 - d[mine]) * told[mine], low[mine], told[mine].astype(float))]
        hashes = np.append(before.hashes, U64(before.begin_hash)).view(np.int64)
        of = np.zeros(len(sums[0]), np.int64)
        of[history[mine]] = seen[mine]
        have = np.nonzero(sums[2][: len(hashes)] > 0)[0]
        owned.append((hashes[have], sums[0][have], sums[1][have], sums[2][have], of[have]))
        backs = [(h[~kept[h[:, 0]]]) for h in backs]  # a longer n-gram that is kept has no shorter one backed off from
        needs = np.nonzero(~kept & (seen >= s.kept(length)))[0]
        backs.append(np.stack([needs, hashes[history[needs]]], 1))
        with np.errstate(divide="ignore", invalid="ignore"):
            q = d * told / np.maximum(seen, 1)
            score = np.where(kept, np.log10(q), score)
        low = np.where(kept, q, low)
    b.levels = levels
    documents.append(np.add.reduceat(score, b.starts))
    doc = np.repeat(np.arange(len(b.sizes)), b.sizes)
    at = np.concatenate([np.zeros((0, 2), np.int64), *backs])
    return documents, (doc[at[:, 0]], at[:, 1]), tuple(np.concatenate([np.zeros(0, owned[0][i].dtype if owned else float), *(o[i] for o in owned)]) for i in range(5))


def planes(values: np.ndarray, level: int = 1) -> bytes:
    """Numbers below 2**32, compressed byte by byte."""
    return zstandard.compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), level)


def unplaned(data: bytes) -> np.ndarray:
    return np.frombuffer(inflated(data), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def pickled(per: np.ndarray, at: np.ndarray) -> bytes:
    """The two arrays as bytes, the first with its length in front."""
    first = planes(per)
    return len(first).to_bytes(8, "little") + first + planes(at)


def unpickled(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    end = 8 + int.from_bytes(data[:8], "little")
    return unplaned(data[8:end]).astype(np.int64), unplaned(data[end:]).astype(np.int64)


def weighed(needs: pa.Table, weights: pa.Table) -> pa.Table:
    """A bucket's answers: to each block the log10 backoff weights of its hashes, in its order; 0 for those that have none."""
    history, weight = (weights.column(k).to_numpy() for k in ("history", "weight"))
    order = np.argsort(history.view(U64))
    history, weight = history.view(U64)[order], weight[order]
    out = []
    for data in needs.column("data").to_pylist():
        hashes = unpacked(data)
        at = np.minimum(np.searchsorted(history, hashes), max(len(history) - 1, 0))
        found = np.where(history[at] == hashes, weight[at], 0.0) if len(history) else np.zeros(len(hashes))
        out.append(deflated(found.view(np.uint8).reshape(-1, 8).T.tobytes()))
    return pa.table([needs.column("block"), needs.column("ix"), pa.array(out, pa.binary())], names=["block", "bucket", "weights"])


def score(documents: DataFrame, folds: int = 7, held: int = 2, block_tokens: int = BLOCK_TOKENS, order: int = 3, cutoff: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of documents(doc_id, text).

    There are about two buckets an input partition. A task holds one block (some 200 bytes a token) or one bucket; larger blocks
    have fewer distinct n-grams a token and larger packets, so executors with more memory should take them."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    df = documents.select("doc_id", "text", F.coalesce(remainder(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"))
    bits = min(18, max(6, 1 + math.ceil(math.log2(max(1, df.rdd.getNumPartitions())))))
    s = Statistics(cutoff)
    texts = token_blocks(df, block_tokens)
    answers = answered(requests(texts, bits, order), s, "counts")
    tables = [texts, answers]
    s.unseen = unseen_mass(answers, s)

    def block_of(left: pa.Table, right: pa.Table) -> Block:
        told: dict[int, list] = {}
        ordered = right.sort_by([("length", "ascending"), ("bucket", "ascending")])
        for length, n, a in zip(*(ordered.column(k).to_pylist() for k in ("length", "n", "answer")), strict=True):
            told.setdefault(length, []).append(loosened(a, n))
        for length in range(3, max(told) + 1):
            told.setdefault(length, [np.zeros(0, np.int64)])
        return rebuilt(Block.read(*(left.column(k)[0].as_py() for k in ("sizes", "tokens", "hashes"))), {k: np.concatenate(v) for k, v in told.items()}, s)

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        """The requests of a block for the next length."""
        release_memory()
        b = block_of(left, right)
        length = len(b.levels) + 1
        level = b.extend(b.wanted(s.documents, s.kept(length)))
        train = ~np.array(left.column("held_out")[0].as_py(), bool)
        return pa.Table.from_batches([packets(left.column("block")[0].as_py(), length, level.hashes, b.counted(level, train), bits)])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        release_memory()
        block = left.column("block")[0].as_py()
        b = block_of(left, right)
        while len(b.levels) < order:  # no block had a longer n-gram to ask for
            b.extend(np.zeros(len(b.tokens), bool)).learn(np.zeros(0, np.int64))
        docs, (doc, wanted), owned = scored(b, s)
        del b
        order_ = np.argsort(doc, kind="stable")
        doc, wanted = doc[order_], wanted[order_]
        wanted, at = np.unique(wanted.view(U64), return_inverse=True)
        edges = by_bucket(wanted, bits)
        asked = [(i, packed(wanted[a:z])) for i, (a, z) in enumerate(zip(edges.tolist(), edges[1:].tolist(), strict=False)) if z > a]
        n, no = len(docs[0]), len(owned[0])
        long, double = pa.int64(), pa.float64()
        documents_, needs, sums = ({"kind": pa.array([k] * m, pa.string()), "block": pa.array([block] * m, long)} for k, m in (("document", n), ("need", len(asked)), ("owned", no)))
        documents_ |= {"ix": pa.array(range(n), pa.int32()), "doc_id": left.column("doc_id").combine_chunks().flatten(), "held_out": left.column("held_out").combine_chunks().flatten(), "n_tokens": pa.array(docs[0], long), "n_known": pa.array(docs[1], long), "base_score": pa.array(docs[2], double), "score": pa.array(docs[3], double)}
        # with the block's first document: how many histories each document backs off from, and which
        documents_["data"] = pa.array([pickled(np.bincount(doc, minlength=n), at), *[None] * (n - 1)], pa.binary())
        needs |= {"ix": pa.array([i for i, _ in asked], pa.int32()), "data": pa.array([x for _, x in asked], pa.binary())}
        sums |= {"hash": pa.array(owned[0], long), "x": pa.array(owned[1], double), "y": pa.array(owned[2], double), "kept": pa.array(owned[3].astype(np.int64), long), "seen": pa.array(owned[4].astype(np.int64), long)}
        fields = [pa.field(k, documents_[k].type if k in documents_ else sums[k].type) for k in NAMES["part"]]
        whole = pa.concat_tables([pa.table([x.get(f.name, pa.nulls(len(x["kind"]), f.type)) for f in fields], names=NAMES["part"]) for x in (documents_, needs, sums)])
        return pa.Table.from_batches(whole.combine_chunks().to_batches(max_chunksize=20_000))  # the JVM holds a batch at a time

    def finished(left: pa.Table, right: pa.Table) -> pa.Table:
        """The documents of a block with the weights that it asked for."""
        left, right = left.sort_by("ix"), right.sort_by("bucket")
        per, at = unpickled(left.column("data")[0].as_py())
        weights = np.concatenate([np.zeros(0), *(np.frombuffer(inflated(x), np.uint8).reshape(8, -1).T.copy().view("<f8").ravel() for x in right.column("weights").to_pylist())])
        added = np.bincount(np.repeat(np.arange(len(per)), per), weights[at], len(per))
        total = left.column("score").to_numpy() + added
        out = left.select(["doc_id", "held_out", "n_tokens", "n_known"]).append_column("train_tokens", pa.array([s.n] * len(left), pa.int64()))
        return out.append_column("base_score", left.column("base_score")).append_column("score", pa.array(total, pa.float64()))

    for length in range(3, order + 1):
        replies = answers.where(F.col("block") >= 0).select("block", "length", "bucket", "n", "answer")
        asked = texts.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(ask, REQUEST)
        tables.append(answered(asked, s, f"counts_{length}"))
        answers = answers.unionByName(tables[-1])
    replies = answers.where(F.col("block") >= 0).select("block", "length", "bucket", "n", "answer")
    parts = stored(texts.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, PART.format(kind=kind)), "parts")
    discard(*tables)
    release_shuffles(df.sparkSession)
    of = parts.where(F.col("kind") == "owned").groupBy("hash")
    owned = of.agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.max("seen").alias("seen"), F.sum("kept").alias("kept"))
    left_over = F.col("x") + (F.col("seen") - F.col("kept"))
    weights = stored(owned.select(F.col("hash").alias("history"), (F.log10(left_over) - F.log10("seen") - F.log10(1 - F.col("y"))).alias("weight")), "weights")
    release_shuffles(df.sparkSession)
    bucket = (F.shiftrightunsigned("history", 64 - bits) if bits else F.lit(0)).cast("int")
    needs = parts.where(F.col("kind") == "need").select("block", "ix", "data")
    replies = needs.groupBy("ix").cogroup(weights.withColumn("ix", bucket).groupBy("ix")).applyInArrow(weighed, "block long, bucket int, weights binary")
    docs = parts.where(F.col("kind") == "document").select("block", "ix", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "data")
    result = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return docs.groupBy("block").cogroup(stored(replies, "weights_by_block").groupBy("block")).applyInArrow(finished, result)


def unseen_mass(answers: DataFrame, s: Statistics) -> float:
    """1 - the sum of P(w) over seen words: what the discounts take, in one pass over the words' answers."""
    if not s.n:
        return 1.0

    def run(batches):
        for batch in batches:
            mass = [0.0]
            for a, n in zip(batch.column("answer").to_pylist(), batch.column("n").to_pylist(), strict=True):
                told = loosened(a, n)
                c = (told >> 1)[(told & 1) == 1]  # each word once, at its owner
                c = c[c > 0]
                mass.append(float(((1 - s.discounts[1](c)) * c).sum()))
            yield pa.RecordBatch.from_arrays([pa.array([math.fsum(mass)])], ["mass"])

    words = answers.where((F.col("block") >= 0) & (F.col("length") == 1)).select("answer", "n")
    return float(words.mapInArrow(run, "mass double").agg(F.sum("mass")).first()[0]) / s.n


def op9_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


QUERIES = {"op9_katz_scoring": op9_katz_scoring}
ORACLE_SQL: dict[str, str] = {}
