"""The training-data operators against brute force, and on rows that are null, empty, long, equal or oddly named."""

import base64
import functools
import hashlib
import html
import itertools
import math
import random
import re
import textwrap
import time
import unicodedata
import uuid
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pagequery.llm import decontaminate, katz, language_id, licences, neighbours, packing, simhash, token_count, url_filter, warc
from pagequery.llm.common import settled
from pagequery.llm.components import components
from pagequery.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
ODD = [
    (1, None, None),
    (2, "", "en"),
    (3, " \n\t ", "en"),
    (4, "the cat sat on the mat and the dog ran away", "en"),
    (4, "the cat sat on the mat and the dog ran away", "en"),
    (None, "der hund und die katze und das haus", "de"),
    (6, "!!! ... 123 <|endoftext|>", "en"),
    (7, "und der die das " * 9000, "de"),
    (8, "É" * 3000, None),
    (9, "x", "de"),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    # columns that clash with what operators use inside
    names = ["fp", "row", "block", "ix", "hash", "score", "lang_pred", "held_out", "seed", "at", "words", "piece", "rank", "task", "kept", "n"]
    return df.select("*", *(F.lit(i).alias(k) for i, k in enumerate(names)))


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_count.tokenizer_path())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


# --- 1: URLs ----------------------------------------------------------------------------------------------------------


def expected_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    best = max((r for r in url_filter.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])), key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best and best[0]


URLS = ["http://A.Example.COM/en/7x?q=1", "https://example.com/en/8#t", "http://com/en/", "http://notcom/en/", "ftp://x.net/de/1", "http://example.net/de/8", "http://a.org?x=/es/", "http://x.org/es/1", "no scheme", "", None, "http://", "http://b.example.com/en/7", "http://ÄB.com/en/x", "a://b://c.com/en/"]


def test_op1_rules_and_trees(spark, documents):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url").unionByName(spark.createDataFrame(list(enumerate(URLS, 10_000)), "page_id long, url string")).withColumn("score", F.lit("x"))
    got = url_filter.filter_urls(pages).collect()
    urls = {r.page_id: r.url for r in pages.collect()}
    assert len(got) == len(urls)
    features, model = url_filter.learnt(pages)
    rows = {r.page_id: r.asDict() for r in features.collect()}
    for r in got:
        host, path, rule, verdict = expected_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if model.score(rows[r.page_id]) > 0 else "allow"))


def test_op1_features(spark):
    url = "http://a.b-c.com/x/1.html?p=1&q=2#f"
    row = url_filter.lexical(url_filter.parsed(spark.createDataFrame([(1, url)], "page_id int, url string"))).first()
    n = Counter(url)
    assert row.entropy == pytest.approx(-sum(v / len(url) * math.log2(v / len(url)) for v in n.values()))
    assert (row.url_length, row.depth, row.parameters, row.host_labels, row.extension, row.fragment, row.hyphens) == (len(url), 2, 2, 3, 1, 1, 1)
    assert row.digit_ratio == pytest.approx(3 / len(url))


def test_op1_learns():
    rng = np.random.default_rng(0)
    x = rng.random((600, 2))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = url_filter.boost(x[:400], y[:400], np.ones(400), ["a", "b"])
    assert np.mean([(model.score({"a": a, "b": b}) > 0) == t for (a, b), t in zip(x[400:], y[400:], strict=True)]) > 0.9


def labelled_by_path(n, seed):
    """URLs whose label is seen in their form alone: long digits in the path of blocked ones."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        host = f"h{rng.randrange(40)}.{rng.choice(['aa', 'bb', 'cc'])}"
        out.append((i, f"http://{host}/{'bad/' + str(rng.randrange(10**9)) if i % 2 else 'good/' + ''.join(rng.choice('abcdef') for _ in range(5))}"))
    return out


RULES_BY_PATH = [("block", tld, "/bad/") for tld in ("aa", "bb", "cc")] + [("allow", tld, "/good/") for tld in ("aa", "bb", "cc")]


def test_op1_held_out_quality(spark):
    pages = spark.createDataFrame(labelled_by_path(3000, 1), "page_id long, url string")
    _, model = url_filter.learnt(pages, RULES_BY_PATH, sample_rows=400)
    assert model.held_out > 0.95
    rng = random.Random(9)  # labels that no feature knows: the suffix statistics must not tell them
    noise = [(i, f"http://x{i}.host{i}.tt/{rng.choice('pqrs')}{i:04d}/") for i in range(800)]
    _, model = url_filter.learnt(spark.createDataFrame(noise, "page_id long, url string"), [(rng.choice(["block", "allow"]), "tt", f"/{a}{b:02d}") for a in "pqrs" for b in range(8)], sample_rows=400)
    assert model.held_out < 0.75


def test_op1_shuffled_suffixes_and_repeats(spark, monkeypatch):
    rows = labelled_by_path(300, 2) + [(7, "http://h1.aa/good/abcde")] * 5 + [(900, "http://h1.aa/" + "x" * 70_000 + "?" + "a=b&" * 5000), (901, None), (902, "http://other.zz/bad/1")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({k: F.lit(1) for k in ("half", "suffix", "n0", "label", "host", "entropy")})
    few = sorted(map(str, url_filter.filter_urls(pages, RULES_BY_PATH).collect()))
    monkeypatch.setattr(url_filter, "BROADCAST_SUFFIXES", 0)
    assert sorted(map(str, url_filter.filter_urls(pages, RULES_BY_PATH).collect())) == few and len(few) == len(rows)


def test_op1_without_labels(spark):
    df = url_filter.filter_urls(spark.createDataFrame([(1, "http://x.fr/a")], "page_id int, url string"))
    assert df.first().verdict == "allow"
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id int, url string")).count() == 0


# --- 2: token counts --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("chunk", [7, 1 << 16])
def test_op2_counts(odd, tokenizer, chunk):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.count_tokens(odd, chunk_chars=chunk).collect())
    assert got == sorted((str(i), len((t or "").encode()), len(ids_of(tokenizer, t)), len(ids_of(tokenizer, t)) > 2048) for i, t, _ in ODD)


def test_op2_words_as_the_library(tokenizer):
    encode = token_count.load(token_count.tokenizer_path())
    odd_words = "It's we'll DON'T 'tis ''s !'s a1b22 x_y _a_ ª º ²3 ½ İ ǅ ß ŉ ÀÉ é <|endoftext|>a 日本語 ١٢ naïve 'S 'Ll ... $1,250.00 µm ˈ ĳ ﬁ ΣΑΣ ſ Ⅷ 👍🏽 ñ ñ".split(" ")
    for texts in (odd_words, ["plain,", "words", "", "x's!!"], odd_words[:1]):
        ids, lengths = encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [ids_of(tokenizer, w) for w in texts]


def test_op2_forgetting_changes_nothing(tokenizer, documents):
    for ids in (True, False):
        encode = token_count.load(token_count.tokenizer_path(), ids)
        encode.most, encode.transducer.most = 300, 500
        machine = token_count.Fields(encode, edges=400)
        for r in documents.limit(40).collect():
            codes, starts = token_count.read_texts(machine, list(token_count.spans([r.text]))[0])
            assert starts[-1] == len(ids_of(tokenizer, r.text))
            if ids:
                assert machine.ids(codes).tolist() == ids_of(tokenizer, r.text)


def test_op2_transducer_emits_what_the_library_counts(tokenizer):
    transducer = token_count.Transducer(token_count.Vocabulary(token_count.tokenizer_path()))
    rng = random.Random(5)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for letters in ("ab", "aet", "abcdefghijklmnopqrstuvwxyz", "éàtion") for _ in range(500)]
    words += ["a" * n for n in range(1, 70)] + ["é" * n for n in range(1, 40)] + ["!" * n for n in range(1, 40)]
    for w in words:
        want = ids_of(tokenizer, w)
        assert transducer.ids(w.encode()) == want and transducer.count(w.encode()) == len(want)
    # a transition is a function of state and byte: emitted tokens add up to the same on every way
    assert all(x & 255 < 64 for x in transducer.step.values()) and len(transducer.states) < len(words) * 20


def test_op2_refuses_tokens_that_span_spaces():
    with pytest.raises(ValueError, match="white space"):
        token_count.load(token_count.tokenizer_path("byte_bpe_50k.json"))


@pytest.mark.parametrize("text", ["A<|STARTOFTEXT|>B <|startoftext|>", "Plain TEXT Here", "Mixed É İ ẞ <|x"])
def test_op2_case(spark, tokenizer, text):
    assert token_count.count_tokens(spark.createDataFrame([(1, text)], "doc_id int, text string")).first().n_tokens == len(ids_of(tokenizer, text))


def test_op2_composition_is_associative():
    machine = token_count.machine_of(token_count.tokenizer_path())
    rng = random.Random(1)
    for _ in range(50):
        text = "".join(rng.choice("ab c\n,") for _ in range(30)).encode()
        cuts = sorted(rng.sample(range(31), 4))
        maps = [token_count.chunk_map(text[a:b], machine) for a, b in itertools.pairwise([0, *cuts, len(text)])]
        right = maps[-1]
        for m in maps[-2::-1]:
            right = token_count.compose(m, right, machine)
        assert token_count.total(token_count.prefixes(maps, machine)[-1], machine) == token_count.total(right, machine) == token_count.total(token_count.chunk_map(text, machine), machine)


def test_op2_prefixes_of_chunks(spark, tokenizer):
    rng = random.Random(2)
    texts = ["".join(rng.choice("the cat, sat é\n1") for _ in range(rng.randint(0, 300))) for _ in range(12)] + ["x" * 200, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    got = {(r.key, r.ix): (r.tokens_before, bytes(r.open)) for r in token_count.token_offsets(df, "key", chunk_chars=10, block=3).collect()}
    for key, text in enumerate(texts):
        for ix in range(max(1, -(-len(text) // 10))):
            before = text[: 10 * ix]
            cut = max([i + 1 for i, c in enumerate(before) if c.isspace()], default=0)
            assert got.pop((key, ix)) == (len(ids_of(tokenizer, before[:cut])), before[cut:].encode())
    assert not got


def test_op2_empty(none):
    assert token_count.count_tokens(none).count() == 0


# --- 3: WARC ----------------------------------------------------------------------------------------------------------


def test_op3_records(spark, tmp_path):
    page = "<html lang=fr><head><title>A &amp; B</title><style>p{}</style></head><body><!-- x --><p>One<br>two <b>three</b></p><script>var t='</p>';</script><a href='/x'>link</a></body>"
    pages = spark.createDataFrame([(1, "http://a/", page), (2, None, None), (2, None, None), (3, "http://b/", "<script>never closed")], "page_id int, url string, html string")
    records = warc.derivatives(warc.responses_of_pages(pages), ("page_id",))
    rows = records.collect()
    assert len(rows) == 8 and len({r.record_id for r in rows}) == 6
    text = next(r for r in rows if r.page_id == 1 and r.record_type == "conversion")
    assert text.block == "A & B\nOne\ntwo three\nlink" and text.content_length == len(text.block.encode())
    meta = next(r for r in rows if r.page_id == 1 and r.record_type == "metadata")
    assert "title: A & B\r\n" in meta.block and "outlink: /x\r\n" in meta.block and "language: fr" in meta.block and text.refers_to == meta.refers_to
    assert next(r for r in rows if r.page_id == 3 and r.record_type == "conversion").block == ""
    warc.written(records, str(tmp_path / "w"))
    back = [r for f in sorted((tmp_path / "w").glob("part*")) for r in warc.parsed(f.read_bytes()) if r["warc-type"] != "warcinfo"]
    assert sorted((r["warc-record-id"], r["block"].decode()) for r in back) == sorted((r.record_id, r.block) for r in rows)
    assert all(r["warc-block-digest"] == warc.digest(r["block"]) for r in back)


def test_op3_reads_responses(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n<p>hi"
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nWARC-Target-URI: http://a/\r\nContent-Length: {len(body)}\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(head.encode() + body + b"\r\n\r\n")
    responses = warc.responses_of_files(spark.read.format("binaryFile").load(str(tmp_path)))
    row = responses.first()
    assert (row.source_id, row.headers, bytes(row.payload)) == ("<urn:uuid:1>", "HTTP/1.1 200 OK\r\nServer: x", b"<p>hi")
    assert {r.refers_to for r in warc.derivatives(responses).collect()} == {"<urn:uuid:1>"}


class PlainPage(HTMLParser):
    """The facts of a page by the standard library's parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=False)
        self.parts, self.title, self.links, self.lang, self.silent, self.in_title = [], [], [], None, None, False
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if self.silent:
            return
        self.parts.append("\n" if tag in warc.BREAKS else " " if tag in warc.SILENT else "")
        self.silent = tag if tag in warc.SILENT else None
        self.in_title |= tag == "title"
        if tag == "a" and attrs.get("href"):
            self.links.append(" ".join(attrs["href"].split()))
        if tag == "html" and self.lang is None:
            self.lang = attrs.get("lang")

    def handle_endtag(self, tag):
        if self.silent:
            self.silent = None if tag == self.silent else self.silent
            return
        self.parts.append("\n" if tag in warc.BREAKS else "")
        self.in_title &= tag != "title"

    def handle_comment(self, data):
        self.parts.append("" if self.silent else " ")

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)
            self.title += [data] if self.in_title else []

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")

    def text(self):
        lines = (" ".join(html.unescape(x).split()) for x in "".join(self.parts).split("\n"))
        return "\n".join(x for x in lines if x)


def test_op3_is_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    sources = {r.page_id: r for r in pages.collect()}
    rows = warc.op3_warc_derivatives(spark, "/root/testdata/sf0.01").collect()
    assert Counter(r.page_id for r in rows) == Counter({i: 2 for i in sources})
    for r in rows:
        source = sources[r.page_id]
        page, data = PlainPage(source.html or ""), (source.html or "").encode()
        named = uuid.UUID(hashlib.md5(f"response {source.page_id} {source.url or ''}".encode()).hexdigest()[:12] + "3" + hashlib.md5(f"response {source.page_id} {source.url or ''}".encode()).hexdigest()[13:])
        assert r.refers_to.startswith(f"<urn:uuid:{str(named)[:18]}") and r.target_uri == source.url
        assert r.content_length == len(r.block.encode()) and r.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(r.block.encode()).digest()).decode()
        assert r.source_digest == "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode() and r.digest_state == "computed"
        assert r.headers.endswith(f"Content-Length: {len(data)}")
        if r.record_type == "conversion":
            assert r.block == page.text()
        else:
            facts = [x.split(": ", 1) for x in r.block.split("\r\n") if x]
            assert [v for k, v in facts if k == "outlink"] == page.links
            assert dict(facts).get("title", "") == " ".join(html.unescape("".join(page.title)).split()) and dict(facts).get("language") == page.lang
            assert dict(facts)["source-payload-length"] == str(len(data))


def test_op3_bytes_and_digests(spark):
    latin = "<p>caf\u00e9".encode("latin-1")
    right = warc.digest(latin)
    rows = [("<a>", "http://x/\nEvil: 1", "d", "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1", latin, right, "sha1:BLOCK"), ("<b>", None, "d", None, latin, "sha1:WRONG", None), ("<c>", None, None, "Content-Type: text/html; charset=no-such", latin, "md5:1", None), (None, "u1", None, None, None, None, None), (None, "u2", None, None, b"", None, None)]
    got = [r for r in warc.derivatives(spark.createDataFrame(rows, warc.SOURCE)).collect() if r.record_type == "conversion"]
    assert [r.block for r in got] == ["café", "caf\ufffd", "caf\ufffd", "", ""]
    assert [r.digest_state for r in got] == ["verified", "different", "unknown algorithm", "computed", "computed"]
    assert [(r.source_digest, r.source_block_digest) for r in got[:3]] == [(right, "sha1:BLOCK"), ("sha1:WRONG", None), ("md5:1", None)]
    assert len({r.record_id for r in got}) == 5
    written = [r.value for r in warc.serialised(warc.derivatives(spark.createDataFrame(rows, warc.SOURCE))).collect()]
    assert "WARC-Target-URI: http://x/%0AEvil: 1\r\n" in written[0] and "X-Source-Block-Digest: sha1:BLOCK" in written[0] and not any("\r\nEvil" in x for x in written)


@pytest.mark.parametrize("piece", ["<a ", "<html ", "<title ", "<script ", "<script>x", "<!--", "<a href=' ", "</script ", "<", "<a href", "&amp", "<title>"])
def test_op3_hostile_pages_take_linear_time(piece):
    def took(n):
        start = time.perf_counter()
        warc.Page(piece * n)
        return time.perf_counter() - start

    took(1000)
    assert took(160_000) < 30 * max(took(20_000), 0.005)  # a square would be 64


def test_op3_empty_and_clashing(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>x")], "page_id int, url string, html string").withColumns({k: F.lit(1) for k in ("payload", "headers", "block", "record_id", "source_id")})
    assert warc.derivatives(warc.responses_of_pages(pages), ("page_id",)).count() == 2
    assert warc.derivatives(warc.responses_of_pages(pages.limit(0)), ("page_id",)).count() == 0


# --- 4: neighbours ----------------------------------------------------------------------------------------------------


def test_op4_is_exact(spark):
    rng = np.random.default_rng(2)
    vectors = [v.tolist() for v in rng.normal(size=(400, 20))]
    vectors[7], vectors[9], vectors[11] = vectors[100], vectors[100], [2 * x for x in vectors[100]]
    vectors[20], vectors[21], vectors[22], vectors[23], vectors[24] = None, [0.0] * 20, [float("nan")] * 20, [None] + [1.0] * 19, [1.0] * 3
    rows = [(i, v) for i, v in enumerate(vectors)] + [(None, vectors[1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("block", F.lit(1))
    valid = {i: np.array(v) for i, v in rows if i is not None and v and None not in v and len(v) == 20 and np.isfinite(v).all() and any(v)}
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in neighbours.nearest(df, query_rows=3, candidate_rows=32, slot_rows=50).collect()}
    for q in (i for i in valid if i % 50 == 0):
        scores = sorted(((-float(valid[q] @ v / math.sqrt((valid[q] @ valid[q]) * (v @ v))), i) for i, v in valid.items() if i != q))
        for rank in range(1, 6):
            assert got[q, rank][1] == pytest.approx(-scores[rank - 1][0], abs=1e-12)
            if rank == 1 or scores[rank - 1][0] != pytest.approx(scores[rank - 2][0], abs=1e-9):
                assert got[q, rank][0] == scores[rank - 1][1] or scores[rank][0] == pytest.approx(scores[rank - 1][0], abs=1e-9)
    assert [got[100, r][0] for r in (1, 2)] == [7, 9]  # copies tie exactly, the smaller id first
    assert len(got) == 5 * sum(i % 50 == 0 for i in valid)


def test_op4_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.nearest(df).collect()] == [(0, 1, 1, 0.0)]
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_op4_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.1]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = Counter((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in neighbours.nearest(df, k=3).collect())
    want = Counter()
    for i, (q, v) in enumerate(rows):
        if q % 50 == 0:
            near = sorted((-np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w), c) for j, (c, w) in enumerate(rows) if j != i)[:3]
            want.update((q, rank, c, round(-s, 6)) for rank, (s, c) in enumerate(near, 1))
    assert got == want


def test_op4_many_copies_and_sql(spark, tmp_path):
    rng = np.random.default_rng(7)
    vectors = [v.tolist() for v in rng.normal(size=(300, 6))]
    rows = [(i, vectors[i % 7] if i % 3 else vectors[i]) for i in range(300)] + [(50, vectors[1]), (50, None), (None, vectors[2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = neighbours.op4_nearest_neighbours(spark, str(tmp_path)).toPandas()
    want = by_sql(neighbours.ORACLE_SQL["op4_nearest_neighbours"], embeddings=df)
    got["score"], want["score"] = got["score"].round(9), want["score"].round(9)
    assert same_rows(got, want) and len(got) == 5 * sum(i is not None and i % 50 == 0 and v is not None for i, v in rows)


def test_op4_bounds_hold():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(50, 33)), rng.normal(size=(50, 33)) * 1e200
    a, b = (neighbours.Block.of(np.arange(50), v) for v in (x, y))
    assert a.q.dtype == np.int8 and neighbours.Block.read(dict(zip(("dim", "n", "rows", "q", "scale", "size", "residual"), a.bytes(), strict=True))).product(b).tolist() == (a.q.astype(int) @ b.q.astype(int).T).tolist()
    dots = a.product(b) * (a.scale[:, None] * b.scale)
    y = y / 1e200
    true = (x / np.linalg.norm(x, axis=1)[:, None]) @ (y / np.linalg.norm(y, axis=1)[:, None]).T
    assert (np.abs(dots - true) <= a.size[:, None] * b.residual + a.residual[:, None]).all()


# --- 5: packing -------------------------------------------------------------------------------------------------------


def optimum(items, capacity):
    """The least number of bins, by trying all."""
    best = len(items)
    items = sorted(items, reverse=True)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[i] <= capacity and bins[j] not in bins[:j]:
                go(i + 1, bins[:j] + [bins[j] + items[i]] + bins[j + 1 :])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best


def test_op5_search_is_optimal_on_small_cases():
    rng = random.Random(4)
    improved = 0
    for _ in range(400):
        capacity = rng.choice([10, 20, 30])
        items = [x for _ in range(rng.randint(2, 6)) for x in [rng.randint(2, capacity)] * rng.randint(1, 4)][:11]
        counts = Counter(items)
        packed = packing.bin_completion(counts, capacity, nodes=None)
        assert Counter(k for n, f in packed.patterns for k, v in f for _ in range(n * v)) == counts
        assert all(sum(k * v for k, v in f) <= capacity for _, f in packed.patterns)
        assert packed.proven and packed.sequences == optimum(items, capacity) >= packing.lower_bound(counts, capacity)
        improved += packed.sequences < sum(n for n, _ in packing.best_fit(counts, capacity))
    assert improved


@pytest.mark.parametrize("counts", [{4094: 100, 3: 13651}, {4094: 2040, 3: 13651}, {2: 5_000_000}, {4096: 3, 1: 1}, {}])
def test_op5_very_many_short_pieces(counts):
    packed = packing.bin_completion(counts, 4096)
    assert packed.sequences <= sum(n for n, _ in packing.best_fit(counts, 4096)) and packed.proven
    got = Counter()
    for n, f in packed.patterns:
        assert sum(k * v for k, v in f) <= 4096
        got.update({k: n * v for k, v in f})
    assert got == Counter(counts)


def test_op5_fillings_are_all_and_undominated():
    left = {3: 2, 4: 1, 5: 2, 7: 1, 11: 1}
    for room in range(1, 20):
        rest = {k: v for k, v in left.items() if k != 11}
        lengths, all_ = sorted(rest), set()
        for take in itertools.product(*(range(rest[x] + 1) for x in lengths)):
            if sum(x * n for x, n in zip(lengths, take, strict=True)) == room:
                all_.add(tuple(sorted(((x, n) for x, n in zip(lengths, take, strict=True) if n), reverse=True)))
        reach = packing.reachable(lengths, rest, room)
        got = list(packing.with_sum(lengths, rest, reach, room, None)) if reach[-1] >> room & 1 else []
        assert len(got) == len(all_) and set(got) == all_
        for i, f in enumerate(got):
            assert list(packing.with_sum(lengths, rest, reach, room, f)) == got[i + 1 :]


def test_op5_pieces_and_places(odd, none, tokenizer):
    rows = packing.pack(odd, capacity=64).collect()
    expected = Counter()
    for i, t, _ in ODD:
        ids = [*ids_of(tokenizer, t), 1]
        for k, start in enumerate(range(0, len(ids), 64)):
            part = ids[start : start + 64]
            expected[i, k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in group:
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert packing.pack(none).count() == 0


# --- 6: licences ------------------------------------------------------------------------------------------------------


def test_op6_families(spark, odd):
    lines = {"MIT": "Released under the MIT License.", "Apache": "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0", "GPL": "(c) me. This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC": "Licensed under CC BY-NC 4.0."}
    texts = [(i, f"some text\n{t}\nmore of the same work under way") for i, t in enumerate(lines.values())] + [(100, "He was at MIT to get a license for driving."), (101, "free software in general and public use"), (102, None)]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert {i: (r.paragraph, r.line, r.family, r.confirmed) for i, r in got.items()} == {i: (0, 1, f, True) for i, f in enumerate(lines)}
    assert licences.scan(odd).count() == 0 and licences.scan(odd.limit(0)).count() == 0


def test_op6_short_notices(spark):
    lines = {"Proprietary": "All rights reserved.", "BSD": "BSD license", "MIT": "MIT licensed"}
    texts = [(i, t) for i, t in enumerate(lines.values())] + [(k, f"some text\nAll rights reserved.\nthe rest of number {k}") for k in range(10, 40)]
    got = {r.doc_id: (r.family, r.confirmed) for r in licences.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {**{i: (f, True) for i, f in enumerate(lines)}, **{k: ("Proprietary", True) for k in range(10, 40)}}


def test_op6_wrapped_licences(spark):
    wrap = lambda t, n: "\n".join(textwrap.wrap(t, n))
    prose = "It rained all week and nobody went out.\nThe paper was late again."
    longest = {f: max(ts, key=len) for f, ts in licences.TEMPLATES.items() if f in ("MIT", "Apache", "BSD", "GPL")}
    texts = [(i, f"{prose}\n\n{wrap(t, 60)}\n \n{prose}") for i, t in enumerate(longest.values())] * 2
    texts += [(50, prose + "\n" + "\n".join(["no more than filler here"] * 200) + "\n" + wrap(longest["MIT"], 60) + "\n" + "\n".join(["and filler there"] * 200)), (51, prose.replace("\n", "\r\n\r\n"))]
    got = Counter((r.doc_id, r.paragraph, r.line, r.family, r.confirmed) for r in licences.scan(spark.createDataFrame(texts, "doc_id long, text string")).where("confirmed").collect())
    assert got == {**{(i, 1, -1, f, True): 2 for i, f in enumerate(longest)}, (50, 0, -1, "MIT", True): 1}


def test_op6_is_brute_force(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(9000, "Released under the\nMIT License.\n\nAll rights reserved."), (9000, "Released under the\nMIT License.\n\nAll rights reserved.")], "doc_id long, text string"))
    model = licences.train(df)

    def judged(text):
        g = licences.grams(text)
        x = np.array([[float(v in set(g)) for v in model.vocabulary]])
        p = model.probabilities(x)[0]
        family = model.families[int(p.argmax())]
        if family == licences.UNKNOWN or p.max() <= 0.5:
            return None
        like = max(len(set(licences.bigrams(t)) & set(g)) / len(licences.bigrams(t)) for t in licences.TEMPLATES[family])
        return family, float(p.max()), like, like >= 0.6

    want = Counter()
    for doc_id, text in df.collect():
        for k, block in enumerate(re.split(r"\n(?:[ \t]*\n)+", text.replace("\r\n", "\n").replace("\r", "\n"))):
            lines = block.split("\n")
            by_line = {i: j for i, t in enumerate(lines) if (j := judged(t))}
            windows = [" ".join(lines[a : a + 64]) for a in range(0, max(1, len(lines) - 32), 32)] if len(lines) > 1 else []
            by_block = [j for t in windows if (j := judged(t)) and j[3]]
            if not any(j[3] for j in by_line.values()) and by_block:
                by_line = {-1: max(by_block, key=lambda j: (round(j[2], 6), round(j[1], 6)))}
            want.update((doc_id, k, i, j[0], round(j[1], 4), round(j[2], 6), j[3]) for i, j in by_line.items())
    got = Counter((r.doc_id, r.paragraph, r.line, r.family, round(r.probability, 4), r.similarity, r.confirmed) for r in licences.scan(df, model=model).collect())
    assert got == want and sum(want.values()) > 5


def test_op6_held_out_templates():
    rows = licences.variants()
    texts = lambda held: {frozenset(licences.grams(t)) for t, _, h in rows if h == held}
    assert texts(True) and len([1 for *_, h in rows if h]) > 20
    of = {t: h for f, ts in licences.TEMPLATES.items() for t, h in zip(ts, (i % 3 == 2 for i in range(len(ts))), strict=True)}
    assert all(h == of[t] for t, _, h in rows if t in of)


def test_op6_column_equals_model(spark):
    model = licences.fit([["of", "the"], ["the", "this"], ["under"]])
    texts = [t for ts in licences.TEMPLATES.values() for t in ts] + ["this is the software", "under the"]
    got = {r.doc_id: (r.family, r.probability) for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model=model).collect()}
    for i, t in enumerate(texts):
        x = np.zeros((1, len(model.vocabulary)))
        for g in licences.grams(t):
            if g in model.vocabulary:
                x[0, model.vocabulary.index(g)] = 1
        p = model.probabilities(x)[0]
        family = model.families[int(p.argmax())]
        assert got.get(i, (licences.UNKNOWN, None))[0] == (family if p.max() > 0.5 else licences.UNKNOWN)
        if i in got:
            assert got[i][1] == pytest.approx(p.max(), abs=1e-5)


# --- 7: benchmark -----------------------------------------------------------------------------------------------------


def test_op7_finds_changed_passages(spark, documents):
    items = spark.read.parquet(f"{DATA}/benchmark.parquet").collect()
    rng = random.Random(6)
    rows = []
    for r in items:
        w = r.text.split()
        for k in range(6, len(w), 11):
            w[k] = "changed"
        rows.append((1000 + r.item_id, "before it " + " ".join(w) + " after it"))
    shuffled = [(2000 + r.item_id, " ".join(rng.sample(r.text.split(), len(r.text.split())))) for r in items if len(r.text.split()) > 20]
    df = spark.createDataFrame([*rows, *shuffled, (1, None), (2, ""), (3, "short")], "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    benchmark = spark.createDataFrame([(r.item_id, r.text) for r in items] + [(900, None), (901, "two words"), (902, "five short words stand here"), (903, " ?! ")], "item_id long, text string")
    want = {(1000 + r.item_id, r.item_id) for r in items}
    for settings in ({}, {"block_seeds": 50}, {"block_seeds": 700, "passes": 99}, {"passes": 0}):
        got = {(r.doc_id, r.item_id) for r in contained(df, benchmark, **settings).collect()}
        assert got == want, settings
    short = spark.createDataFrame([(5, "and Five short words, stand here! too"), (6, "five LONG words stand here"), (7, "these two words"), (8, "two other words"), (9, "five long words lie here")], "doc_id long, text string")
    for settings in ({}, {"block_seeds": 50}, {"passes": 0}):
        assert {(r.doc_id, r.item_id) for r in contained(short, benchmark, **settings).collect()} == {(5, 902), (6, 902), (7, 901)}
    kept = {r.doc_id for r in decontaminate.decontaminated(df, benchmark).collect()}
    assert kept == {1, 2, 3} | {i for i, _ in shuffled}


def contained(documents, benchmark, **settings):
    return decontaminate.contained(settled(documents), benchmark, **settings)


def test_op7_alignment(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(1000)]
    item = rng.sample(words, 60)
    filler = [f"f{i}" for i in range(4000)]
    scattered = []
    for at in range(0, 60, 9):  # all of the item, in pieces far apart
        scattered += item[at : at + 9] + filler[at * 20 : at * 20 + 40]
    moved = item[:15] + ["put", "in"] + item[15:30] + item[31:]
    rows = [(1, " ".join(scattered)), (2, " ".join(moved)), (3, " ".join(filler[:50] + item[20:48] + filler[50:90])), (4, " ".join(item[:20])), (5, " ".join(item))]
    rows += [(6, " ".join(filler * 10 + item + filler * 10)), (5, " ".join(item))]
    long = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(filler[:1500]))], "item_id long, text string")
    for settings in ({}, {"passes": 0}, {"block_seeds": 500}):
        got = Counter((r.doc_id, r.item_id) for r in contained(spark.createDataFrame(rows, "doc_id long, text string"), long, **settings).collect())
        assert {k: v for k, v in got.items() if k[1] == 7} == {(2, 7): 1, (3, 7): 1, (5, 7): 2, (6, 7): 1}, settings
        assert (6, 8) in got


def test_op7_seeds_are_brute_force(spark, documents):
    benchmark = spark.read.parquet(f"{DATA}/benchmark.parquet")
    items = {r.item_id: r.text for r in benchmark.collect()}
    got = {(r.doc_id, r.item_id) for r in contained(documents, benchmark).collect()}
    whole = {(d.doc_id, i) for d in documents.collect() for i, t in items.items() if t in d.text}
    assert whole <= got and len(got) <= len(whole) + 3
    assert contained(documents.limit(0), benchmark).count() == 0
    assert contained(documents, benchmark.limit(0)).count() == 0


def test_op7_odd_rows(spark, odd, none):
    benchmark = spark.createDataFrame([(1, "the cat sat on the mat and the dog ran away"), (1, "the cat sat on the mat and the dog ran away"), (2, None), (3, ""), (4, "und der die das")], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in contained(odd, benchmark).collect())
    assert got == {(4, 1): 4, (7, 4): 1}
    clash = odd.withColumns({"__pq_row": F.lit(7), "__pq_gone": F.lit(8)})
    kept = decontaminate.decontaminated(clash, benchmark)
    assert kept.columns == clash.columns and len(kept.collect()) == len(ODD) - 3 and {(r["__pq_row"], r["__pq_gone"]) for r in kept.collect()} == {(7, 8)}
    assert decontaminate.decontaminated(none, benchmark).count() == 0 and decontaminate.decontaminated(odd, benchmark.limit(0)).count() == len(ODD)


def by_sql(sql, **tables):
    import duckdb

    c = duckdb.connect()
    for name, df in tables.items():
        c.register(name, df.toArrow() if hasattr(df, "toArrow") else df)
    return c.execute(sql).df()


def same_rows(ours, theirs):
    text = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).values.tolist()))
    return text(ours) == text(theirs)


def test_op7_sql(spark, documents, tmp_path):
    items = spark.createDataFrame([(900, "five short words stand here"), (901, "one two"), (902, None), (903, "a b c d e f g h i j")], "item_id long, text string")
    benchmark = spark.read.parquet(f"{DATA}/benchmark.parquet").unionByName(items)
    more = spark.createDataFrame([(70001, "x five short WORDS stood here"), (70002, "one two"), (70003, None), (70004, "z a b c d e f g X i j a b c")], "doc_id long, text string")
    docs = documents.select("doc_id", "text").unionByName(more)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    ours = decontaminate.op7_decontamination(spark, str(tmp_path))
    assert same_rows(ours.toPandas(), by_sql(decontaminate.ORACLE_SQL["op7_decontamination"], documents=docs, benchmark=benchmark))
    assert {70001, 70002, 70004} <= {r.doc_id for r in ours.collect()}


# --- 8: languages -----------------------------------------------------------------------------------------------------


def test_op8_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_op8_bundles_are_the_sum_of_bound_letters():
    text = "abc de"
    total = np.zeros(language_id.DIMENSIONS)
    padded = f" {text} "
    for a, b, c in zip(padded, padded[1:], padded[2:], strict=False):
        total += np.roll(language_id.letter(ord(a)), 2) * np.roll(language_id.letter(ord(b)), 1) * language_id.letter(ord(c))
    assert (language_id.bundle(text, language_id.Trigrams()) == total).all()


def test_op8_prediction_is_brute_force(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").collect()[:60]
    df = spark.createDataFrame([(r.doc_id, r.text, r.lang) for r in rows], "doc_id long, text string, lang string")

    def vector(text):
        text = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
        total, padded = np.zeros(language_id.DIMENSIONS), f" {' '.join(text.split())} "
        for (a, b, c), n in Counter(zip(padded, padded[1:], padded[2:], strict=False)).items():
            total += n * np.roll(language_id.letter(ord(a)), 2).astype(float) * np.roll(language_id.letter(ord(b)), 1) * language_id.letter(ord(c))
        return total

    sums = {}
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang:
            sums[r.lang] = sums.get(r.lang, 0) + vector(r.text)
    names = sorted(sums)
    unit = np.array([sums[k] / np.linalg.norm(sums[k]) for k in names])
    unit -= unit.mean(0)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for r, got in zip(sorted(rows, key=lambda r: r.doc_id), sorted(language_id.identify(df).collect(), key=lambda r: r.doc_id), strict=True):
        v = vector(r.text)
        cosines = unit @ v / np.linalg.norm(v)
        assert got.score == pytest.approx(min(1, max(0, cosines.max())), abs=1e-5) and (got.lang_pred == names[int(cosines.argmax())] or np.ptp(np.sort(cosines)[-2:]) < 1e-6)


NUMERALS = [(20, "½ ²"), (21, "①"), (22, "Ⅷ ٣"), (23, "\u0301\u094d"), (24, "__ -"), (25, "नमस्ते दुनिया"), (26, "a")]


def test_op8_odd_rows(spark, odd, none):
    rows = odd.unionByName(spark.createDataFrame(NUMERALS, "doc_id long, text string"), allowMissingColumns=True)
    texts = [t for _, t, _ in ODD] + [t for _, t in NUMERALS]
    got = [(r.doc_id, r.lang_pred, r.score) for r in language_id.identify(rows).collect()]
    assert {i for i, p, s in got if p == "und" and s == 0} >= {20, 21, 22, 23, 24}
    assert sum(1 for i, p, s in got if p == "und" and s == 0) == sum(1 for t in texts if not any(unicodedata.category(c)[0] == "L" for c in t or ""))
    assert len(got) == len(texts) and language_id.identify(none).count() == 0
    assert language_id.letters("नमस्ते दुनिया") == "नमस्ते दुनिया"
    clash = rows.withColumns({"__pq_lang": F.lit("mine"), "__pq_near": F.lit(1)})
    kept = language_id.identified(clash)
    assert kept.columns == clash.columns and all(any(c.isalpha() for c in r.text) and r["__pq_lang"] == "mine" for r in kept.collect())
    assert language_id.identified(none).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    with pytest.raises(ValueError, match="languages"):
        language_id.prototypes(spark.createDataFrame([("a", "x"), ("b", "y")], "text string, lang string"), languages=1)


def test_op8_rejects_what_is_in_no_language_learnt(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    foreign = ["Привет мир, это русский текст и больше ничего", "これは日本語の文章です。とても短い。", "مرحبا بالعالم هذا نص طويل", "안녕하세요 세계 이것은 글입니다", "zxqj vvkq wpzzx qqxj jjqz"]
    more = df.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(100_000 + i, t, None) for i, t in enumerate(foreign)], "doc_id long, text string, lang string"))
    kept = {r.doc_id for r in language_id.identified(more).select("doc_id").collect()}
    clean = {r.doc_id for r in df.collect()}
    assert not kept - clean and len(clean - kept) <= 0.002 * len(clean)
    german = {r.doc_id for r in language_id.identified(more, wanted=("de",)).select("doc_id").collect()}
    of = {r.doc_id for r in df.where("lang = 'de'").collect()}
    assert len(german ^ of) <= 0.02 * len(of)


# --- 9: Katz ----------------------------------------------------------------------------------------------------------


def katz_by_hand(rows, order, cutoff=2):
    """The texts' tokens, word counts, N, V, the model as a function of (history, word), and all histories that were seen."""
    tokens = [(t or "").encode().lower().split() + [b"END"] for _, t in rows]
    train = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for i, _ in rows]
    grams, followed = defaultdict(Counter), defaultdict(Counter)
    for t, use in zip(tokens, train, strict=True):
        padded = (b"BEGIN",) * (order - 1) + tuple(t)
        for i in range(len(t) if use else 0):
            for k in range(1, order + 1):
                gram = padded[order - k + i : order + i]
                grams[k][gram] += 1
                followed[k][gram[:-1]] += 1
    words = Counter({g[0]: c for g, c in grams[1].items()})
    n, v = sum(words.values()), len(words)
    least = {k: 1 if k <= 2 else cutoff for k in range(1, order + 1)}
    discounts = {k: katz.Discount(dict(Counter(c for c in grams[k].values() if c >= least[k])), least[k]) for k in grams}
    d = lambda k, c: float(discounts[k](np.array([c]))[0])
    unseen = 1 - sum(d(1, c) * c for c in words.values()) / n
    after = defaultdict(list)
    for k in range(2, order + 1):
        for g, c in grams[k].items():
            if c >= least[k]:
                after[g[:-1]].append((g[-1], c))

    @functools.cache
    def p(history, w):
        k = len(history) + 1
        if k == 1:
            return d(1, words[w]) * words[w] / n if words[w] else unseen
        c = grams[k][(*history, w)]
        if c >= least[k]:
            return d(k, c) * c / followed[k][history]
        return weight(history) * p(history[1:], w)

    @functools.cache
    def weight(history):
        k = len(history) + 1
        if not followed[k][history]:
            return 1.0
        kept = after[history]
        return (1 - sum(d(k, c) * c / followed[k][history] for _, c in kept)) / (1 - sum(p(history[1:], w) for w, _ in kept))

    return tokens, words, n, v, p, [h for k in range(2, order + 1) for h in followed[k]]


@pytest.mark.parametrize("order, cutoff", [(1, 2), (2, 2), (3, 2), (3, 1), (4, 2)])
def test_op9_equals_recursion(documents, order, cutoff):
    rows = [(r.doc_id, r.text) for r in documents.limit(60).collect()] + [(i, t) for i, t, _ in ODD]
    df = documents.sparkSession.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit(0))
    tokens, words, n, v, p, histories = katz_by_hand(rows, order, cutoff)
    got = Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 5)) for r in katz.score(df, block_tokens=5000, order=order, cutoff=cutoff).collect())
    want = Counter()
    for (i, _), t in zip(rows, tokens, strict=True):
        padded = (b"BEGIN",) * (order - 1) + tuple(t)
        score = sum(math.log10(p(padded[j : j + order - 1], w)) for j, w in enumerate(t))
        want[i, len(t), sum(w in words for w in t), n, round(sum(math.log10((words[w] + 1) / (n + v + 1)) for w in t), 6), round(score, 5)] += 1
    assert got == want
    for h in histories[:: max(1, len(histories) // 60)]:  # exactly normalised over all words and the unseen one
        assert sum(p(h, w) for w in [*words, b"never seen"]) == pytest.approx(1, abs=1e-9)


def test_op9_empty(none):
    assert katz.score(none).count() == 0


def test_op9_packs():
    rng = np.random.default_rng(0)
    h = np.sort(rng.integers(0, 2**64, 1000, dtype=np.uint64))
    for part in (h, h[:1], h[:0]):
        assert (katz.unpacked(katz.packed(part)) == part).all()
    c = rng.integers(0, 600, 1000)
    assert (katz.loosened(katz.squeezed(c), 1000) == c).all()


# --- 10: SimHash ------------------------------------------------------------------------------------------------------


def fingerprint_by_hand(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op10_equals_brute_force(documents, odd):
    rows = [(r.doc_id, r.text) for r in documents.collect()] + [(i if i is None else i + 10_000, t) for i, t, _ in ODD]
    base = rows[0][1].split()
    rows += [(20_000 + k, " ".join([*base[:k], "x", *base[k + 1 :]])) for k in range(0, len(base), 9)]
    df = documents.sparkSession.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    fps = [fingerprint_by_hand(t) for _, t in rows]
    near = [[j for j in range(len(rows)) if (fps[i] ^ fps[j]).bit_count() <= 3] for i in range(len(rows))]
    label = list(range(len(rows)))
    while (new := [min(label[j] for j in near[i]) for i in range(len(rows))]) != label:
        label = new
    least = {}
    for (i, _), x in zip(rows, label, strict=True):
        if i is not None:
            least[x] = min(least.get(x, i), i)
    want = Counter((i, f"{f:016x}", least.get(x)) for (i, _), f, x in zip(rows, fps, label, strict=True))
    assert Counter(tuple(r) for r in simhash.near_duplicates(df).collect()) == want
    assert simhash.deduplicated(df).count() == len(set(label))
    assert simhash.deduplicated(odd).columns == odd.columns and simhash.near_duplicates(odd.limit(0)).count() == 0


@pytest.mark.parametrize("extra", [0, 1, 2])
def test_op10_no_key_misses(spark, extra):
    rng = random.Random(extra)
    pairs = []
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 3):
            y ^= 1 << b
        pairs.append(tuple(v - (v >> 63 << 64) for v in (x, y)))
    df = spark.createDataFrame(pairs, "x long, y long")
    keys = [simhash.keys_of(F.col(c), extra, 3) for c in ("x", "y")]
    agree = F.exists(F.zip_with(F.array(*keys[0]), F.array(*keys[1]), lambda a, b: a == b), lambda v: v)
    assert df.where(agree).count() == 300


def test_op10_large_group_in_tiles(spark):
    rng = random.Random(9)
    center = rng.getrandbits(64)
    fps = {center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(2500)}
    far = {rng.getrandbits(64) for _ in range(500)}
    signed = lambda v: v - (v >> 63 << 64)
    df = spark.createDataFrame([(signed(x),) for x in fps | far], "fp long").withColumns(simhash.pivot_columns(F.col("fp")))
    for r in df.limit(20).collect():
        table_ = simhash.distances([np.array([r[f"pivots_{k}"]]) for k in range(simhash.PIVOTS // 8)])[0]
        assert table_.tolist() == [(r.fp % 2**64 ^ int(x)).bit_count() for x in simhash.REFERENCES]
    found = components(simhash.links_of(df))
    members = {r.node for r in found.collect()} | {r.root for r in found.collect()}
    assert found.select("root").distinct().count() == 1 and {signed(x) for x in fps} <= members and len(members) == len(fps)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}


# --- all of them ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
