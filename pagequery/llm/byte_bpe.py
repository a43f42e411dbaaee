"""Byte-level BPE encoding and decoding by a rank queue that is a hierarchical bitmap.

The merge ranks of a vocabulary are the bits of a bitmap of 64-way levels: a bit of an upper level is set where the word below it
holds any. The places of a linked list of symbols lie in buckets, one for each rank, at the left symbol of the pair that this rank
would merge. Finding the first set bit, level by level, picks the next rank, whatever the length of the list; the bucket gives its leftmost
place. An entry is stale, and skipped, where its symbol has gone or its pair has changed since. A merge sets two new pairs and
never scans, so a pre-token of n bytes takes n steps of constant cost (but for the order within a bucket), however long it is.

A text is cut into segments at places that no pre-token spans: before a single space or line feed between characters that are
surely no white space, and after such a line feed. Segments that are short are encoded once a worker, and their ids and their
decimal form kept in tables of bounded size; long ones are encoded as they come. So running text costs a table lookup a word.

Decoding maps ids to their bytes. Both directions are exact: ids are those of the tiktoken library for the same ranks and pattern.

Defined results: a null or empty text has no tokens, its decimal form and decoded bytes are empty. Repeated rows are encoded alike;
ties do not arise. A null doc_id is kept. Texts of any length are read whole. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from .common import release_memory, table

RANKS = "byte_bpe_50k.tiktoken"
#: Characters that every table of Unicode has as visible: a segment may begin and end beside them.
SURE = "!-~¡-¬®-ɏ"
PLAIN = re.compile(f"[{SURE}]*(?:[ \n][{SURE}]+)*")
CUTS = re.compile(f"(?<! )(?= [{SURE}])|(?<=[{SURE}])(?=\n[{SURE}])|(?<=[{SURE}]\n)(?=[{SURE}])")


def segments(text: str) -> list[str]:
    """The text in parts that byte-level pre-tokens do not span: words with the space before them, and line feeds."""
    if PLAIN.fullmatch(text):
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").lstrip("\0").split("\0") if text else []
    at = [0, *(m.start() for m in CUTS.finditer(text)), len(text)]
    return [text[a:b] for a, b in zip(at, at[1:], strict=False) if a < b]


class RankQueue:
    """Places by rank: the least rank first, of one rank the leftmost place.

    Two levels of words of ``WIDTH`` bits: a word for each ``WIDTH`` ranks, and one with a bit for each of these words (a vocabulary has
    some hundred). ``merged`` has push and pop in line, since a call costs as much as they do."""

    WIDTH, SHIFT = 512, 9

    def __init__(self, ranks: int):
        self.words = [0] * (ranks // self.WIDTH + 1)
        self.bit = [1 << i for i in range(max(self.WIDTH, len(self.words)))]
        self.buckets: dict[int, list[int]] = {}


class ByteBpe:
    """Encodes and decodes by merge ranks; pattern cuts a text into pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.tokens = ranks, {i: b for b, i in ranks.items()}
        self.pre_tokens = regex.compile(pattern).findall
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)

    @classmethod
    def load(cls, path: str) -> ByteBpe:
        import public_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return cls(ranks, public_tokenizers.PATTERN)

    def merged(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        rank_of, words, bit, buckets, n = ranks.get, self.queue.words, self.queue.bit, self.queue.buckets, len(piece)
        shift, low = self.queue.SHIFT, self.queue.WIDTH - 1
        end = list(range(1, n + 1))  # of the symbol that begins at a place, which is where the next one begins
        before = list(range(-1, n - 1))
        pair = [-1] * n  # the rank that would merge the symbol at a place with the next; -1: none, or the symbol has gone
        top, new = 0, range(n - 1)  # the upper level; places whose pair may be new
        while True:
            for i in new:
                j = end[i]
                rank = rank_of(piece[i : end[j]], -1) if j < n else -1
                if pair[i] != rank:
                    pair[i] = rank
                    if rank >= 0:
                        if rank in buckets:
                            heapq.heappush(buckets[rank], i)
                        else:
                            buckets[rank] = [i]
                            word = rank >> shift
                            if not words[word]:
                                top |= bit[word]
                            words[word] |= bit[rank & low]
            while top:
                word = (top & -top).bit_length() - 1  # find first set, on both levels
                held = words[word]
                first = held & -held
                rank = word << shift | (first.bit_length() - 1)
                bucket = buckets[rank]
                i = heapq.heappop(bucket)
                if not bucket:
                    del buckets[rank]
                    words[word] = held ^ first
                    if held == first:
                        top ^= bit[word]
                if pair[i] == rank:  # else it is stale
                    break
            else:
                break
            j = end[i]
            k = end[i] = end[j]
            pair[i] = pair[j] = -1
            if k < n:
                before[k] = i
            h = before[i]
            new = (i,) if h < 0 else (h, i)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: str) -> list[int]:
        return [i for p in self.pre_tokens(text) for i in self.merged(p.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Kept(dict):
    """What make(key) gave, by key: short keys are kept, up to about so many bytes in all, then all but the first third go, since what is frequent was met early."""

    def __init__(self, make: Callable, longest: int = 64, most: int = 400_000_000):
        super().__init__()
        self.make, self.longest, self.most, self.size = make, longest, most, 0

    def __missing__(self, key: str):
        value = self.make(key)
        if len(key) <= self.longest:
            self[key] = value
            self.size += 2 * len(key) + 200
        return value

    def bounded(self) -> None:
        """Called between texts."""
        if self.size > self.most:
            kept, self.size = [], 0
            for key, value in self.items():
                self.size += 2 * len(key) + 200
                if self.size > self.most // 3:
                    break
                kept.append((key, value))
            self.clear()
            self.update(kept)
            self.size = sum(2 * len(k) + 200 for k, _ in kept)
            release_memory()


class Codec:
    """Encodes texts by segments, whose ids in decimal are kept; decodes by the same decimals."""

    def __init__(self, bpe: ByteBpe):
        self.bpe = bpe
        self.kept = Kept(lambda segment: " ".join(map(str, bpe.encode(segment))))
        self.tokens = {str(i): b for i, b in bpe.tokens.items()}

    def __call__(self, text: str | None) -> tuple[list[str], str]:
        """The ids in decimal, one by one and joined by a space."""
        self.kept.bounded()
        joined = " ".join(map(self.kept.__getitem__, segments(text or "")))
        return joined.split(" ") if joined else [], joined

    def decode(self, ids: list[str]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def ranks_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def codec_of(path: str) -> Codec:
    """One a Python process: tasks that follow one another keep what is encoded."""
    return Codec(ByteBpe.load(path))


def slices(batch: pa.RecordBatch, column: str, size: int = 1 << 22) -> Iterator[tuple[pa.RecordBatch, list]]:
    """The batch in slices of about size bytes of a column of texts, with its values."""
    start, held, values = 0, 0, batch.column(column)
    for i in range(len(batch)):
        held += len(values[i].as_buffer() or b"") if values[i].is_valid else 0
        if held >= size or i + 1 == len(batch):
            part = batch.slice(start, i + 1 - start)
            yield part, part.column(column).to_pylist()
            start, held = i + 1, 0


def encoded(documents: DataFrame, path: str | None = None) -> DataFrame:
    """documents(text) with the columns ids (array<int>) and decoded (binary: what the ids decode to) in place of columns of these names."""
    path = path or ranks_path()
    documents = documents.drop("ids", "decoded")
    names = documents.columns

    def run(batches):
        codec = codec_of(path)
        for batch in batches:
            for part, texts in slices(batch, "text"):
                ids = [[*map(int, codec(t)[0])] for t in texts]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32())), pa.array([codec.bpe.decode(i) for i in ids], pa.binary())], [*names, "ids", "decoded"])

    schema = StructType([*documents.schema.fields, StructField("ids", ArrayType(IntegerType())), StructField("decoded", BinaryType())])
    return documents.mapInArrow(run, schema)


def digests(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids, joined by a space), decoded_sha256 for each row of documents(doc_id, text)."""
    path = path or ranks_path()

    def run(batches):
        codec = codec_of(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            rows = []
            for _, texts in slices(batch, "text"):
                for t in texts:
                    ids, joined = codec(t)
                    rows.append((len(ids), sha(joined.encode()), sha(codec.decode(ids))))
            n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op13_byte_bpe": op13_byte_bpe}
ORACLE_SQL: dict[str, str] = {}
