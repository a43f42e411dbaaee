"""Token counts by a compiled finite-state transducer.

The tokenizer cuts a text into words and merges the bytes of each word by rank. This is compiled into a deterministic transducer
over bytes. Of all prefixes of a word, the tokenisation has one last token each, and a token t that ends at a place is that last
token if and only if it is compatible with the last token before it: no merge of lower rank joins the two across their border. So
a state needs, for each place from which a token of the vocabulary may still be under way, the node of the vocabulary's trie
that it has come to, the last token before it, and how many tokens stand before it. States are interned and transitions computed
when they are first taken (determinisation as it is met). A transition is annotated with the tokens that it emits: by how many
the number rises that stands before every place under way, whatever follows. The closing transition of a word's last byte
emits the rest. Ids are read back along the same path, by the last tokens of its states.

Paths from the start state through a whole word, and through a white-space separated field of words, are kept as compressed
edges with the sum of their annotations. States and edges are bounded in number; beyond that all but those met first go, and are
compiled again.

A chunk of a text is a function on states: silent (no white space: open field p becomes p + fragment), or it closes the incoming field with
its head, emits the count of its inner fields and leaves its tail open. These maps are closed under composition, which is
associative. Chunks of a long text are evaluated apart and their maps scanned in two levels, blocks of chunks in tasks of their
own: the composed block maps give each block its prefix, and these give each chunk the tokens before it (``token_offsets``).

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted alike; a null doc_id is kept; an
empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, category, numbered, release_memory, settled, stored, table

TOKENIZER = "word_bpe_49k.json"
SPACES = b" \t\n\r\x0b\x0c"


@lru_cache(maxsize=1)
def any_words() -> re.Pattern:
    """The tokenizer's pattern of words, over all of Unicode."""
    letters, numbers = category("L"), category("N")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|(?:[^\\s{letters}{numbers}]|[\\x1c-\\x1f])+")  # white space but for four that only Python has


def byte_characters() -> list[str]:
    """The character that stands for each byte in the vocabulary: itself where that can be printed, else the next one from U+0100."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b if b in printed else next(others)) for b in range(256)]


class Vocabulary:
    """What a BPE of words with ends is compiled from: its tokens as a trie over base tokens, and which may stand side by side."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model = made["model"]
        if model.get("end_of_word_suffix") != "</w>" or "Lowercase" not in json.dumps(made["normalizer"]) or "\\s" not in json.dumps(made["pre_tokenizer"]):
            raise ValueError(f"{path}: not a lower-casing tokenizer of words; its tokens may span white space")
        ids: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.inner = [ids[c] for c in byte_characters()]  # the base token of a byte within a word, and at its end
        self.final = [ids[c + "</w>"] for c in byte_characters()]
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pair, token = (ids[a], ids[b]), ids[a + b]
            self.pairs[pair] = rank
            if token not in self.parts:
                self.parts[token], self.rank[token] = pair, rank
        self.size = max(ids.values()) + 1
        base: dict[int, tuple[int, ...]] = {t: (t,) for t in (*self.inner, *self.final)}
        self.child: dict[int, int] = {}  # node * size + base token -> node; 0 is the root
        self.token, self.open = [-1], [True]  # of a node: the token that ends there; whether a longer one goes on
        for token, (a, b) in self.parts.items():  # by rank, so parts come first
            base[token] = base[a] + base[b]
        for token, path_ in base.items():
            node = 0
            for x in path_:
                self.open[node] = True
                key = node * self.size + x
                node = self.child.get(key, 0)
                if not node:
                    node = self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.open.append(False)
            self.token[node] = token
        self.known: dict[int, bool] = {}
        self.path, self.library = path, None

    def newer(self, text: str) -> list[bytes]:
        """The words of a text with characters that are newer than Python's tables, normalised and cut by the library."""
        from tokenizers import Tokenizer

        if self.library is None:
            self.library = Tokenizer.from_file(self.path)
        back = {c: b for b, c in enumerate(byte_characters())}
        return [bytes(map(back.__getitem__, w)) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def spine(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """What stands at a token's left (0) or right (1) edge while it is merged: (token, rank by which it came, rank by which it went)."""
        out, gone = [], len(self.pairs)
        while True:
            out.append((token, self.rank.get(token, -1), gone))
            if token not in self.parts:
                return out
            gone, token = self.rank[token], self.parts[token][side]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the tokens stay apart side by side: no pair across their border is merged while both its parts stand there.

        Of equal ranks the merge further left comes first: that within a, and before that within b the one across."""
        if a < 0:
            return True
        key = a * self.size + b
        found = self.known.get(key)
        if found is None:
            left, right = self.spine(a, 1), self.spine(b, 0)
            found = not any(
                came < q < gone and came_b < q <= gone_b
                for x, came, gone in left
                for y, came_b, gone_b in right
                if (q := self.pairs.get((x, y))) is not None
            )
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[key] = found
        return found


class Transducer:
    """The deterministic transducer of a word's bytes: states by number, and transitions with what they emit, compiled when first taken."""

    def __init__(self, vocabulary: Vocabulary, states: int = 400_000):
        self.vocabulary, self.most = vocabulary, states
        self.clear()

    def clear(self) -> None:
        self.states, self.numbers = [], {}
        self.last: list[int] = []  # the last token of what was read
        self.step: dict[int, int] = {}  # state << 8 | byte -> next state << 8 | tokens emitted
        self.close: dict[int, int] = {}  # the same for a word's last byte -> last token << 8 | tokens emitted
        self.state([(0, -1, 0)])

    def room(self, state: int) -> int:
        """The state's number; beyond the bound all states go but this one, so that a word of any length is read in bounded memory."""
        if len(self.states) <= self.most:
            return state
        values = array("i", self.states[state])
        self.clear()
        return self.state([*zip(values[::3], values[1::3], values[2::3], strict=True)])

    def state(self, live: list[tuple[int, int, int]]) -> int:
        """The number of the state with these places under way, (node, last token before, tokens before beyond those emitted); the last is the present one."""
        key = array("i", chain.from_iterable(live)).tobytes()
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
            self.last.append(live[-1][1])
        return number

    def ways(self, state: int, base: int) -> Iterator[tuple[int, int, int]]:
        """The places under way that the base token goes on from, as (node it comes to, last token before, tokens before)."""
        v, values = self.vocabulary, array("i", self.states[state])
        for i in range(0, len(values), 3):
            node = v.child.get(values[i] * v.size + base)
            if node is not None:
                yield node, values[i + 1], values[i + 2]

    def compile(self, state: int, byte: int) -> int:
        v, live, ended = self.vocabulary, [], None
        for node, last, before in self.ways(state, v.inner[byte]):
            token = v.token[node]
            if token >= 0 and v.compatible(last, token):
                ended = (0, token, before + 1)
            if v.open[node]:
                live.append((node, last, before))
        live.append(ended)
        emitted = min(x[2] for x in live)
        out = self.step[state << 8 | byte] = self.state([(n, t, k - emitted) for n, t, k in live]) << 8 | emitted
        return out

    def compile_close(self, state: int, byte: int) -> int:
        v = self.vocabulary
        for node, last, before in self.ways(state, v.final[byte]):
            if (token := v.token[node]) >= 0 and v.compatible(last, token):
                break
        out = self.close[state << 8 | byte] = token << 8 | (before + 1)
        return out

    def count(self, word: bytes) -> int:
        """The tokens emitted on the way through a word."""
        state = emitted = 0
        step = self.step
        for byte in word[:-1]:
            x = step.get(state << 8 | byte)
            if x is None:
                state = self.room(state)
                step = self.step
                x = self.compile(state, byte)
            state = x >> 8
            emitted += x & 255
        x = self.close.get(state << 8 | word[-1])
        return emitted + ((self.compile_close(state, word[-1]) if x is None else x) & 255)

    def ids(self, word: bytes) -> list[int]:
        """The tokens themselves."""
        state, last = 0, array("i", [-1])  # the last token of what was read, at each place
        for byte in word[:-1]:
            x = self.step.get(state << 8 | byte)
            if x is None:
                state = self.room(state)
                x = self.compile(state, byte)
            state = x >> 8
            last.append(self.last[state])
        x = self.close.get(state << 8 | word[-1])
        token, at, out = (self.compile_close(state, word[-1]) if x is None else x) >> 8, len(word), []
        while token >= 0:
            out.append(token)
            at -= self.length(token)
            token = last[at]
        return out[::-1]

    def length(self, token: int) -> int:
        """In bytes."""
        lengths = self.__dict__.setdefault("lengths", {})
        if token not in lengths:
            parts = self.vocabulary.parts.get(token)
            lengths[token] = sum(map(self.length, parts)) if parts else 1
        return lengths[token]


def load(path: str, ids: bool = True) -> Words:
    """encode(list of fields) -> (all ids or None, number of ids of each field), for a tokenizers file.

    Fields are independent, and case is lost, only where the model lower-cases and drops white space; any other is refused."""
    return Words(Vocabulary(path), ids)


def together(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), "<u4", int(lengths.sum())), lengths


class Store:
    """Numbers of tokens by number of an edge, and the tokens themselves if ids are wanted: appended together, gathered by number."""

    def __init__(self, ids: bool):
        self.ids, self.n, self.used = ids, 0, 0
        self.start, self.length, self.pool = np.zeros(1 << 12 if ids else 0, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14 if ids else 0, "<u4")

    def append(self, ids: np.ndarray | None, lengths: np.ndarray) -> None:
        n = self.n + len(lengths)
        self.length = grown(self.length, n)
        self.length[self.n : n] = lengths
        if self.ids:
            used = self.used + len(ids)
            self.start, self.pool = grown(self.start, n), grown(self.pool, used)
            self.start[self.n : n] = self.used + np.cumsum(lengths) - lengths
            self.pool[self.used : used] = ids
            self.used = used
        self.n = n

    def forget(self, numbers: dict, keep: int) -> defaultdict:
        """Drops all but the first keep numbers, here and in the dictionary of their keys: what is frequent was met early."""
        out = numbering()
        out.update(islice(numbers.items(), keep))
        self.n, self.used = keep, int(self.start[keep]) if self.ids else 0
        return out

    def gather(self, numbers: np.ndarray) -> np.ndarray | None:
        if not self.ids:
            return None
        n = self.length[numbers]
        before = np.cumsum(n) - n
        return self.pool[np.repeat(self.start[numbers] - before, n) + np.arange(n.sum())]


def grown(array: np.ndarray, n: int) -> np.ndarray:
    if n <= len(array):
        return array
    out = np.zeros(max(n, 2 * len(array)), array.dtype)
    out[: len(array)] = array
    return out


def numbering() -> defaultdict:
    """A dictionary that gives each new key the next number."""
    out: defaultdict = defaultdict()
    out.default_factory = out.__len__
    return out


def newest(numbers: dict, n: int) -> list:
    return list(islice(reversed(numbers), n))[::-1]


class Words:
    """The compressed edges of whole words. Fields are cut into words as the tokenizer cuts them: those of Latin letters, digits and
    signs all in one pass, others one by one after normalisation."""

    #: Letters below U+0250, digits and signs, without characters that change their kind or number in lower case or are parts of letters or digits.
    PLAIN = re.compile("[\n!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u01c3\u01cd-\u01f0\u01f4-\u0249]*")
    WORD = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\n]|_)+")

    def __init__(self, vocabulary: Vocabulary, ids: bool = True, words: int = 400_000):
        self.ids, self.most = ids, words
        self.transducer = Transducer(vocabulary)
        self.specials = vocabulary.specials
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.newer = vocabulary.newer
        self.words, self.store = numbering(), Store(ids)
        self.words["\n"]  # between fields: no token
        self.store.append(np.zeros(0, "<u4"), np.zeros(1, np.int64))

    def is_plain(self, text: str) -> bool:
        return bool(self.PLAIN.fullmatch(text)) and not ("<" in text and any(x in text for x in self.specials))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray | None, np.ndarray]:
        joined = "\n".join(texts)
        if self.is_plain(joined):
            return self.plain(joined, len(texts))
        odd = [i for i, t in enumerate(texts) if not self.is_plain(t)]
        ids, lengths = self.plain("\n".join("" if not self.is_plain(t) else t for t in texts), len(texts))
        read = [self.odd(texts[i]) for i in odd]
        if self.ids:
            more, sizes = together(read)
            places = np.repeat((np.cumsum(lengths) - lengths)[odd], sizes)
            ids = np.insert(ids, places, more)
        lengths[odd] = sizes if self.ids else read
        return ids, lengths

    def odd(self, text: str) -> list[int] | int:
        """The ids of a field, or their number; special tokens are found before the text is normalised."""
        ids, n = [], 0
        for part in self.special.split(text) if self.special else [text]:
            if part in self.specials:
                ids.append(self.specials[part])
                n += 1
                continue
            if any(unicodedata.category(c) == "Cn" for c in part):
                words = self.newer(part)
            else:
                normal = "".join(c.lower() for c in unicodedata.normalize("NFC", part))
                words = map(str.encode, any_words().findall(normal))
            for word in words:
                if self.ids:
                    ids += self.transducer.ids(word)
                else:
                    n += self.transducer.count(word)
        return ids if self.ids else n

    def plain(self, joined: str, n: int) -> tuple[np.ndarray | None, np.ndarray]:
        if self.store.n > self.most:
            self.words = self.store.forget(self.words, self.most // 3)
        if len(self.transducer.states) > self.transducer.most:
            self.transducer.clear()
        words = self.WORD.findall(joined.lower())
        numbers = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        new = newest(self.words, len(self.words) - self.store.n)
        if self.ids:
            self.store.append(*together([self.transducer.ids(w.encode()) for w in new]))
        else:
            self.store.append(None, np.fromiter((self.transducer.count(w.encode()) for w in new), np.int64, len(new)))
        lengths = np.bincount(np.cumsum(numbers == 0), self.store.length[numbers], n).astype(np.int64)
        return self.store.gather(numbers), lengths


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def machine_of(path: str, ids: bool = False) -> Fields:
    """One machine a Python process: tasks that follow one another on a worker keep what is compiled."""
    return Fields(load(path, ids))


class Fields:
    """The compressed edges of whole fields, which white space closes. Each has a number, by which the store tells how many tokens it emits, and which."""

    def __init__(self, encode: Words, edges: int = 750_000, edge_bytes: int = 24_000_000):
        self.encode, self.edges, self.edge_bytes = encode, edges, edge_bytes
        self.closing, self.store, self.held = numbering(), Store(encode.ids), 0

    def read(self, fields: Iterable[bytes], n: int) -> np.ndarray:
        """The edges of n fields, by number; valid until the next reading."""
        if self.store.n > self.edges or self.held > self.edge_bytes:
            keep = sum(1 for size in accumulate(map(len, islice(self.closing, self.edges // 3))) if size <= self.edge_bytes // 3)
            self.closing = self.store.forget(self.closing, keep)
            self.held = sum(map(len, self.closing))
            release_memory()
        codes = np.fromiter(map(self.closing.__getitem__, fields), np.int64, n)
        new = newest(self.closing, len(self.closing) - self.store.n)
        self.held += sum(map(len, new))
        for i in range(0, len(new), 1 << 14):
            self.store.append(*self.encode([k.decode() for k in new[i : i + (1 << 14)]]))
        return codes

    def emitted(self, codes: np.ndarray) -> np.ndarray:
        """How many tokens each edge emits."""
        return self.store.length[codes]

    def ids(self, codes: np.ndarray) -> np.ndarray:
        """The tokens that they emit, one after another."""
        return self.store.gather(codes)

    def count(self, fields: list[bytes]) -> int:
        return int(self.emitted(self.read(fields, len(fields))).sum())


def read_texts(machine: Fields, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The edges of all fields of all texts, and where each text's tokens begin (and the last one's end)."""
    lists = [b.split() for b in texts]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    codes = machine.read(chain.from_iterable(lists), int(sizes.sum()))
    tokens = np.concatenate([[0], np.cumsum(machine.emitted(codes))])
    return codes, tokens[np.concatenate([[0], np.cumsum(sizes)])]


#: The map of a chunk: (None, fragment) is silent, else (head, emitted, tail).
def chunk_map(chunk: bytes, machine: Fields) -> tuple:
    fields = chunk.split()
    if not fields:
        return (b"", 0, b"") if chunk else (None, b"")
    if len(fields) == 1 and len(fields[0]) == len(chunk):
        return (None, chunk)
    head = b"" if chunk[:1] in SPACES else fields.pop(0)
    tail = b"" if chunk[-1:] in SPACES else fields.pop()
    return (head, machine.count(fields), tail)


def compose(a: tuple, b: tuple, machine: Fields) -> tuple:
    if a[0] is None:
        return (None, a[1] + b[1]) if b[0] is None else (a[1] + b[0], b[1], b[2])
    if b[0] is None:
        return (a[0], a[1], a[2] + b[1])
    middle = [a[2] + b[0]] if a[2] + b[0] else []
    return (a[0], a[1] + machine.count(middle) + b[1], b[2])


SILENT = (None, b"")  # the map of the empty chunk


def prefixes(maps: list[tuple], machine: Fields) -> list[tuple]:
    """The composition of all maps before each, and of all of them at the end."""
    return list(accumulate(maps, lambda a, b: compose(a, b, machine), initial=SILENT))


def total(composed: tuple, machine: Fields) -> int:
    """What the map emits from the start state, with the end of the text."""
    ends = [x for x in (composed[1:] if composed[0] is None else (composed[0], composed[2])) if x]
    return machine.count(ends) + (0 if composed[0] is None else composed[1])


def spans(texts: list, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The texts as bytes (null: empty), in lists of about size bytes; A-Z in lower case, as the tokenizer has them, unless a special token may be meant."""
    out, n = [], 0
    for x in texts:
        b = x.encode() if x else b""
        b = b if b"<|" in b else b.lower()
        out.append(b)
        n += len(b)
        if n >= size:
            yield out
            out, n = [], 0
    if out:
        yield out


MAP = "head binary, emitted long, tail binary"


def map_columns(maps: list[tuple]) -> list[pa.Array]:
    return [pa.array([m[0] for m in maps], pa.binary()), pa.array([m[1] if len(m) == 3 else 0 for m in maps], pa.int64()), pa.array([m[-1] for m in maps], pa.binary())]


def maps_of(rows: pa.Table) -> list[tuple]:
    return [SILENT[:1] + (t,) if h is None else (h, e, t) for h, e, t in zip(*(rows.column(k).to_pylist() for k in ("head", "emitted", "tail")), strict=True)]


def chunk_maps(documents: DataFrame, path: str, per: Column, keep: list[str]) -> DataFrame:
    """keep, ix (from 0), head, emitted, tail: the maps of the chunks of per characters of each row of documents(keep, text)."""
    last = F.greatest(F.ceil(F.length("text") / per).cast("int") - 1, F.lit(0))
    parts = documents.select(*keep, "text", per.alias("per"), F.explode(F.sequence(F.lit(0), last)).alias("ix"))
    parts = parts.select(*keep, "ix", F.col("text").substr(F.col("ix") * F.col("per") + 1, F.col("per")).alias("chunk"))

    def run(batches):
        machine = machine_of(path)
        for batch in batches:
            made = [chunk_map(x.encode(), machine) for x in batch.column("chunk").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map_columns(made)], [*batch.schema.names[:-1], "head", "emitted", "tail"])

    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    return parts.mapInArrow(run, f"{kinds}, ix int, {MAP}")


def block_maps(maps: DataFrame, path: str, key: str, keep: list[str], block: int) -> DataFrame:
    """The first sweep: a row (keep, block, head, emitted, tail) for each block of so many chunks of a key's text."""

    def run(rows: pa.Table) -> pa.Table:
        machine, rows = machine_of(path), rows.sort_by("ix")
        first = rows.slice(0, 1).select([*keep, "block"])
        for name, column in zip(("head", "emitted", "tail"), map_columns(prefixes(maps_of(rows), machine)[-1:]), strict=True):
            first = first.append_column(name, column)
        return first

    kinds = ", ".join(f"`{c}` {maps.schema[c].dataType.simpleString()}" for c in keep)
    return maps.withColumn("block", F.floor(F.col("ix") / block).cast("int")).groupBy(key, "block").applyInArrow(run, f"{kinds}, block int, {MAP}")


def token_offsets(documents: DataFrame, key: str, path: str | None = None, chunk_chars: int = 1 << 16, block: int = 16) -> DataFrame:
    """key, ix, tokens_before, open: for each chunk of the texts of documents(key, text) the tokens closed before it and the field that is open at its start.

    A parallel prefix scan: chunk maps are composed to block maps, these scanned, and the prefix of its block handed down to each chunk.
    key: a column that no two rows share."""
    path = path or tokenizer_path()
    maps = stored(chunk_maps(documents.where(F.col("text").isNotNull()), path, F.lit(chunk_chars), [key]), "chunks")
    blocks = block_maps(maps, path, key, [key], block)
    kind = documents.schema[key].dataType.simpleString()
    out = f"`{key}` {kind}, block int, {MAP}"

    def down(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("block")
        made = map_columns(prefixes(maps_of(rows), machine_of(path))[:-1])
        return pa.table([rows.column(key), rows.column("block"), *made], names=[key, "block", "head", "emitted", "tail"])

    before = blocks.groupBy(key).applyInArrow(down, out)

    def hand(left: pa.Table, right: pa.Table) -> pa.Table:
        machine, left = machine_of(path), left.sort_by("ix")
        found = [compose(*maps_of(right), m, machine) for m in prefixes(maps_of(left), machine)[:-1]]
        tokens = [0 if m[0] is None else m[1] + machine.count([m[0]] if m[0] else []) for m in found]
        return pa.table([left.column(key), left.column("ix"), pa.array(tokens, pa.int64()), pa.array([m[-1] for m in found], pa.binary())], names=[key, "ix", "tokens_before", "open"])

    dealt = maps.withColumn("block", F.floor(F.col("ix") / block).cast("int"))
    return dealt.groupBy(key, "block").cogroup(before.groupBy(key, "block")).applyInArrow(hand, f"`{key}` {kind}, ix int, tokens_before long, open binary")


def count_tokens(documents: DataFrame, path: str | None = None, limit: int = 2048, chunk_chars: int = 1 << 16, block: int = 16) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of documents(doc_id, text).

    Texts of up to chunk_chars characters are one chunk. Longer ones are cut into chunks (256 at most, of chunk_chars at least)
    that are dealt over the cluster; a text's maps then meet by its row key, block by block."""
    path = path or tokenizer_path()
    df = numbered(settled(documents), "doc_id", "text")
    size = F.coalesce(F.length("text"), F.lit(0))

    def short(batches):
        machine = machine_of(path)
        for batch in batches:
            n_bytes, n = [], []
            for part in spans(batch.column("text").to_pylist()):
                n += np.diff(read_texts(machine, part)[1]).tolist()
                n_bytes += map(len, part)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    def composed(rows: pa.Table) -> pa.Table:
        machine, rows = machine_of(path), rows.sort_by("block")
        whole = prefixes(maps_of(rows), machine)[-1]
        return rows.slice(0, 1).select(["doc_id", "n_bytes"]).append_column("n_tokens", pa.array([total(whole, machine)], pa.int64()))

    kind = documents.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_bytes long, n_tokens long"
    whole = df.where(size <= chunk_chars).select("doc_id", "text").mapInArrow(short, out)
    keep = [ROW, "doc_id", "n_bytes"]
    long = df.where(size > chunk_chars).select(ROW, "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    maps = chunk_maps(long, path, F.greatest(F.lit(chunk_chars), F.ceil(F.length("text") / 256).cast("int")), keep)
    long = block_maps(maps, path, ROW, keep, block).groupBy(ROW).applyInArrow(composed, out)
    return whole.unionByName(long).withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op2_token_count": op2_token_count}
ORACLE_SQL: dict[str, str] = {}
