"""Fill-in-the-middle, tokenizer alignment and byte-level BPE against brute force and the libraries, and on odd rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pagequery.llm import alignment, byte_bpe, fill_in_middle
from pagequery.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n", "\n\n\n", "one line", "a\nb\nc", "a\nb\nc", "ends\n", "has <P> inside\nand more\n", "é中文😀\n x\r\ny", "x" * 70_000, "line\n" * 20_000, "  \n" * 300, "▁ literal", "<|endoftext|> <s> <0x41>", "\0 \x1c\x85"]
CHARACTERS = [*" \n\n  ab'strelvmd19!?.<>é中文　\x1c\x85\xa0ﬁ​́\r\tαβ😀\0▁", "<|endoftext|>", "<s>", "</s>", "<0x41>"]


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i != 3 else None, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    names = ["n", "form", "output", "unit", "pos", "ordinal", "size", "end", "pairs", "times", "n_a", "ids", "decoded", "n_tokens", "__pq_row"]
    return df.select("*", *(F.lit(i).alias(k) for i, k in enumerate(names)))


def random_texts(n, seed=1):
    made = random.Random(seed)
    return ["".join(made.choice(CHARACTERS) for _ in range(made.randint(0, 16))) for _ in range(n)]


def test_segments_join_to_the_text():
    for t in [*random_texts(5000), *filter(None, ODD)]:
        assert "".join(byte_bpe.segments(t)) == t
        assert all(byte_bpe.segments(t))


# --- 11: fill in the middle -------------------------------------------------------------------------------------------


def expected_middle(doc_id, text, rate=100, spm=50):
    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    digits = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return (doc_id, len(units), "plain", None, None, t)
    if h4 % 100 < spm:
        return (doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def by_text(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (100, 0), (100, 100), (40, 30)])
def test_op11_equals_a_cut_by_hand(odd, rate, spm):
    made = fill_in_middle.transformed(odd, rate=rate, spm=spm)
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    rows = made.select("doc_id", "n_units", "form", "prefix_chars", "middle_chars", "output", F.coalesce("text", F.lit("")).alias("text"), back.alias("back")).collect()
    assert all(r["back"] == r["text"] for r in rows)
    assert by_text(tuple(r)[:6] for r in rows) == by_text(expected_middle(None if i == 3 else i, t, rate, spm) for i, t in enumerate(ODD))


def test_op11_keeps_other_columns_and_empty_tables(odd):
    made = fill_in_middle.transformed(odd)
    assert set(odd.columns) - {"form", "output"} <= set(made.columns)
    assert made.filter(F.col("n") != 0).isEmpty()  # the input's own column n
    assert fill_in_middle.transformed(odd.limit(0)).isEmpty()


def test_op11_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    rows = QUERIES["op11_fill_in_middle"](spark, DATA).collect()
    want = [(*(e := expected_middle(d["doc_id"], d["text"]))[:5], sha(e[5]), sha(d["text"] or "")) for d in docs]
    assert by_text(map(tuple, rows)) == by_text(want)
    assert {r["form"] for r in rows} >= {"psm", "spm"}


def test_op11_sentinels_that_overlap_are_refused():
    for marks in (("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("<", "<P>", "<M>"), ("", "a", "b"), ("aa", "b", "c")):
        with pytest.raises(ValueError, match="overlap"):
            fill_in_middle.Sentinels(*marks)


def test_op11_moves_each_text_once(spark):
    made = fill_in_middle.transformed(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and plan.count("Exchange hashpartitioning") <= 3
    exchanges = [x for x in plan.splitlines() if "Exchange" in x]
    assert exchanges


# --- 12: alignment ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def sides():
    return [alignment.byte_side(public_tokenizers.path(alignment.BYTE)), alignment.piece_side(public_tokenizers.path(alignment.PIECE))]


@pytest.fixture(scope="module")
def whole(sides):
    """text -> A ids and B ids of the whole text, or none where the bytes differ."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path(alignment.BYTE))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.PIECE))

    def read(text):
        if not text:
            return [], []
        ids, pieces = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        same = all(b"".join(side.tokens[i] for i in x) == (" " + text).encode() for side, x in zip(sides, (ids, pieces), strict=True))
        return (ids, pieces) if same else ([], [])

    return read


def groups_by_walking(a, b, sides):
    """The groups, by going along both sequences a token at a time."""
    out, left, right, at_a, at_b, i, j = [], [], [], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if at_a <= at_b and i < len(a):
            at_a += len(sides[0].tokens[a[i]])
            left.append(a[i])
            i += 1
        else:
            at_b += len(sides[1].tokens[b[j]])
            right.append(b[j])
            j += 1
        if at_a == at_b:
            out.append((left, right))
            left, right = [], []
    assert not left and not right
    return out


def expected_alignment(texts, whole, sides):
    groups = [groups_by_walking(*whole(t), sides) for t in texts]
    links = [Counter((x, y) for g, h in one for x in g for y in h) for one in groups]
    held = Counter(p for one in links for p in one)
    top = {}
    for (a, _), n in held.items():
        top[a] = max(top.get(a, 0), n)
    out = []
    for one, counted in zip(groups, links, strict=True):
        best = sum(k for (a, b), k in counted.items() if held[a, b] == top[a])
        text = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in one)
        out.append((sum(len(g) for g, _ in one), sum(len(h) for _, h in one), len(one), sum(counted.values()), best, sum(k * held[p] for p, k in counted.items()), sha(text) if one else ""))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("most", [1_000_000, 300, 0])
def test_op12_equals_a_walk(spark, odd, sides, whole, most):
    texts = [*ODD, *(r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect()), *random_texts(300)]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    rows = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.align_tokenizers(df, most=most).collect()}
    want = dict(enumerate(expected_alignment(texts, whole, sides)))
    assert rows == want


def test_op12_query_and_odd_rows(spark, odd, sides, whole):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = {d["doc_id"]: e for d, e in zip(docs, expected_alignment([d["text"] for d in docs], whole, sides), strict=True)}
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in QUERIES["op12_tokenizer_alignment"](spark, DATA).collect()} == want
    assert alignment.align_tokenizers(odd).count() == len(ODD)
    assert alignment.align_tokenizers(odd.limit(0)).isEmpty()


def test_op12_long_groups_are_products_of_distinct_ids():
    a, b = np.zeros(50_000, np.int64), np.arange(30_000) % 3
    pairs, times, _ = alignment.products(a, b, np.zeros(50_000, np.int64), np.zeros(30_000, np.int64))
    assert pairs.tolist() == [0, 1, 2]
    assert times.tolist() == [50_000 * 10_000] * 3


def test_op12_forgets_and_learns_again(sides, whole):
    aligner = alignment.Aligner(*sides, segments_kept=50, longest=8)
    texts = [t for t in random_texts(400, 5) if t] + ["some words in a row, again and again " * 9]
    for i in range(0, len(texts), 40):
        part = texts[i : i + 40]
        made = aligner(part)
        for k, t in enumerate(part):
            one = groups_by_walking(*whole(t), sides)
            assert made["n_links"][k] == sum(len(g) * len(h) for g, h in one)
            assert sum(made["times"][k].as_py()) == made["n_links"][k]


# --- 13: byte-level BPE -----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBpe.load(byte_bpe.ranks_path())


@pytest.fixture(scope="module")
def library(bpe):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def test_op13_equals_the_library(bpe, library):
    codec = byte_bpe.Codec(bpe)
    for t in [*random_texts(8000, 3), *ODD]:
        ids, joined = codec(t)
        assert [*map(int, ids)] == library.encode_ordinary(t or "") and joined == " ".join(ids)
        assert codec.decode(ids) == (t or "").encode()


def test_op13_very_long_pre_tokens(bpe, library):
    made = random.Random(7)
    for t in ("a" * 100_000, "ab" * 40_000, "".join(made.choice("abcdefgh") for _ in range(100_000)), "中文字符" * 10_000, " " * 50_000, "=-" * 20_000):
        assert bpe.encode(t) == library.encode_ordinary(t)


def test_op13_any_ranks():
    """Ranks that no training gives: pairs of lower rank may arise late, and equal symbols overlap."""
    import tiktoken

    made = random.Random(11)
    for _ in range(60):
        tokens = {bytes([b]): b for b in range(256)}
        while len(tokens) < 300:
            tokens.setdefault("".join(made.choice("abc") for _ in range(made.randint(2, 6))).encode(), len(tokens))
        order = [*range(256, 300)]
        made.shuffle(order)
        ranks = {t: i if i < 256 else order[i - 256] for t, i in tokens.items()}
        ours, theirs = byte_bpe.ByteBpe(ranks, r"\S+|\s+"), tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
        for _ in range(40):
            t = "".join(made.choice("abc ") for _ in range(made.randint(0, 40)))
            assert ours.encode(t) == theirs.encode_ordinary(t)


def test_op13_tables_are_bounded():
    kept = byte_bpe.Kept(str.upper, longest=5, most=5000)
    for i in range(1000):
        assert kept[f"k{i % 90}"] == f"K{i % 90}"
        kept.bounded()
        assert kept.size <= 5000 + 300
    assert kept["much longer"] == "MUCH LONGER" and "much longer" not in kept


def test_op13_query_and_odd_rows(spark, odd, library):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = {d["doc_id"]: (len(ids := library.encode_ordinary(d["text"] or "")), sha(" ".join(map(str, ids))), sha(d["text"] or "")) for d in docs}
    rows = QUERIES["op13_byte_bpe"](spark, DATA).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows} == want
    made = byte_bpe.encoded(odd).collect()
    assert by_text((r["ids"], r["decoded"]) for r in made) == by_text((library.encode_ordinary(t or ""), (t or "").encode()) for t in ODD)
    assert byte_bpe.digests(odd.limit(0)).isEmpty() and byte_bpe.digests(odd).count() == len(ODD)
