"""WARC derivatives: a metadata record and a plain-text conversion record for each response record.

Both refer to their source (WARC-Refers-To, its target URI and date), keep the source's headers and digests, and carry digests of
their own. The source's digests are those that its record states; the payload's is computed from its bytes where none is stated,
and compared where one is (``digest_state``). Record ids are name-based UUIDs of the source's id and the record's kind, so a repeated run gives the same records.

Records are rows; ``written`` serialises them to WARC files through Spark's text writer, each record a gzip member of its own behind a
warcinfo record, so files go wherever Spark can write and readers can seek by record. ``responses_of_files`` reads WARC files back into rows, a record at a time, and goes on
after whatever is malformed: its ``state`` is "whole", "short" (fewer bytes than stated), "no length" (none stated, or no number; the block goes on to
the next record) or "unreadable" (compressed data that breaks; reading goes on with the next member, and the row holds nothing else).

Pages are read in one pass over their marks: every pattern matches wherever it begins, so time is in proportion to the length of any page.

Defined results: a null payload is empty, a null URL is left out of the headers; both still give two records. A source without an id
is named by its URL, date and payload, and referred to by these alone. Bytes that are no text of the charset that the source's headers name become
U+FFFD in the derivatives, as do surrogates; a charset that is missing, unknown or no character set (``TEXT_ENCODINGS``) is read as UTF-8; digests and lengths are those of the bytes. Repeated rows give
repeated records with the same ids. Markup that is not closed runs to the end of the page. Line ends in a URL are percent-encoded in
headers. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import codecs
import contextlib
import datetime
import gzip
import hashlib
import html
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "warc-derivatives")
#: Elements whose content is no text, and elements that end a line.
SILENT = frozenset("script style template noscript".split())
BREAKS = frozenset(
    "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split()
)
MARK = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<rest>[^>]*)(?:>|\Z)|<[/!?][^>]*(?:>|\Z)", re.S | re.I)
CLOSING = {name: re.compile(rf"</{name}\s*>", re.I) for name in SILENT}
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
CHARSET = re.compile(r"^content-type:[^\r\n]*?charset=\s*[\"']?([\w.:-]+)", re.I | re.M)

#: Character sets, by Python's names; its other codecs transform texts or bytes.
TEXT_ENCODINGS = frozenset(
    "ascii utf-8 utf-8-sig utf-16 utf-16-le utf-16-be utf-32 utf-32-le utf-32-be gb2312 gbk gb18030 hz big5 big5hkscs cp950 euc_jp euc_jis_2004 shift_jis cp932 iso2022_jp iso2022_kr euc_kr cp949 johab koi8-r koi8-u koi8-t mac-roman mac-cyrillic mac-greek mac-latin2 mac-turkish tis-620 cp437 cp850 cp852 cp866 cp874".split()
    + [f"iso8859-{i}" for i in range(1, 17)]
    + [f"cp{i}" for i in range(1250, 1259)]
)

SOURCE = "source_id string, target_uri string, date string, headers string, payload binary, payload_digest string, block_digest string"
RECORD = "record_id string, record_type string, refers_to string, target_uri string, date string, content_type string, content_length long, block_digest string, source_digest string, source_block_digest string, digest_state string, headers string, block string"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def urn(kind: str, source_id: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{kind} {source_id}')}>"


def one_line(text: str) -> str:
    return " ".join(html.unescape(text).split())


class Page:
    """What derivatives need of a page: its text (a line for each block, white space collapsed, references resolved), title, language and links."""

    def __init__(self, page: str):
        parts, title, links = [], None, []
        self.language, at, in_title = None, 0, False
        while m := MARK.search(page, at):
            parts.append(page[at : m.start()])
            if in_title:
                title.append(parts[-1])
            at, name = m.end(), (m["name"] or "").lower()
            if name in SILENT and not m["end"]:
                parts.append(" ")
                closing = CLOSING[name].search(page, at)
                at = closing.end() if closing else len(page)
            elif not name and m[0].startswith("<!--"):
                parts.append(" ")
            elif name in BREAKS:
                parts.append("\n")
            if name == "title":
                in_title = not m["end"] and title is None
                title = [] if title is None else title
            elif name == "a" and not m["end"]:
                links.append(self.attribute(m["rest"], "href"))
            elif name == "html" and not m["end"] and self.language is None:
                self.language = self.attribute(m["rest"], "lang")
        parts.append(page[at:])
        if in_title:
            title.append(parts[-1])
        self.title = one_line("".join(title)) if title else None
        self.links = [x for x in map(one_line, filter(None, links)) if x]
        lines = map(one_line, "".join(parts).split("\n"))
        self.text = "\n".join(x for x in lines if x)

    @staticmethod
    def attribute(tag: str, name: str) -> str | None:
        return next((a or b or c for k, a, b, c in ATTRIBUTE.findall(tag) if k.lower() == name), None)


def decoded(payload: bytes, headers: str | None) -> str:
    named = CHARSET.search(headers or "")
    try:
        name = codecs.lookup(named[1]).name if named else "utf-8"
    except (LookupError, ValueError):
        name = "utf-8"
    if name in TEXT_ENCODINGS and name != "utf-8":
        with contextlib.suppress(UnicodeError):  # a codec that does not know how to replace
            return payload.decode(name, "replace").encode("utf-8", "replace").decode()
    return payload.decode("utf-8", "replace")


def derived(source: dict) -> list[dict]:
    payload = source["payload"] or b""
    computed, stated = digest(payload), source["payload_digest"]
    same = stated and stated.lower().removeprefix("sha1:") == computed.lower().removeprefix("sha1:")
    state = "computed" if not stated else "verified" if same else "unknown algorithm" if not stated.lower().startswith("sha1:") else "different"
    page = Page(decoded(payload, source["headers"]))
    facts = [("via", source["target_uri"] and one_line(source["target_uri"])), ("source-payload-digest", stated or computed), ("source-block-digest", source["block_digest"]), ("source-digest-state", state)]
    facts += [("source-payload-length", str(len(payload))), ("title", page.title), ("language", page.language and one_line(page.language)), *(("outlink", x) for x in page.links)]
    made = [("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in facts if v)), ("conversion", "text/plain; charset=utf-8", page.text)]
    name, out = source["source_id"] or f"{source['target_uri']} {source['date']} {computed}", []
    for kind, content, block in made:
        data = block.encode()
        record = {"record_id": urn(kind, name), "record_type": kind, "refers_to": source["source_id"], "target_uri": source["target_uri"], "date": source["date"], "content_type": content}
        record |= {"content_length": len(data), "block_digest": digest(data), "source_digest": stated or computed, "source_block_digest": source["block_digest"], "digest_state": state}
        out.append(record | {"headers": source["headers"], "block": block})
    return out


def derivatives(responses: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Two records (RECORD) for each response (SOURCE), with the columns of keep."""
    names = [x.split()[0] for x in SOURCE.split(", ")]
    schema = ", ".join([*(f"`{c}` {responses.schema[c].dataType.simpleString()}" for c in keep), RECORD])
    record_names = [x.split()[0] for x in RECORD.split(", ")]

    def run(batches):
        for batch in batches:
            for start in range(0, len(batch), 64):
                part = batch.slice(start, 64)
                rows = [r for s in part.select(names).to_pylist() for r in derived(s)]
                twice = pa.array([i for i in range(len(part)) for _ in (0, 1)], pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(twice) for c in keep), *(pa.array([r[k] for r in rows], pa.int64() if k == "content_length" else pa.string()) for k in record_names)], [*keep, *record_names])

    return responses.select(*keep, *names).mapInArrow(run, schema)


def serialised(records: DataFrame) -> DataFrame:
    """The column value: a record's bytes as WARC 1.1, without the last line feed."""
    uri = F.replace(F.replace("target_uri", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), "record_type"),
        F.concat(F.lit("WARC-Record-ID: "), "record_id"),
        F.concat(F.lit("WARC-Date: "), "date"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Refers-To: "), "refers_to"),
        F.concat(F.lit("WARC-Refers-To-Target-URI: "), uri),
        F.concat(F.lit("WARC-Refers-To-Date: "), "date"),
        F.concat(F.lit("WARC-Block-Digest: "), "block_digest"),
        F.concat(F.lit("X-Source-Payload-Digest: "), "source_digest"),
        F.concat(F.lit("X-Source-Block-Digest: "), "source_block_digest"),
        F.concat(F.lit("X-Source-Headers: "), F.regexp_replace("headers", r"\s*[\r\n]+\s*", " | ")),
        F.concat(F.lit("Content-Type: "), "content_type"),
        F.concat(F.lit("Content-Length: "), F.col("content_length").cast("string")),
    )
    return records.select(F.concat(head, F.lit("\r\n\r\n"), "block", F.lit("\r\n\r")).alias("value"))


def member(record: bytes) -> bytes:
    """A gzip member of a record, without the last byte, which is zero: the size's highest byte, or that of an empty member behind a record of 16 MB and more."""
    data = gzip.compress(record, mtime=0)
    return (data if data[-1] == 0 else data + gzip.compress(b"", mtime=0))[:-1]


def written(records: DataFrame, path: str, software: str = "pagequery") -> None:
    """WARC files in the folder path, one a partition: a warcinfo record, then the records, each a gzip member of its own."""

    def run(batches):
        info = f"software: {software}\r\nformat: WARC File Format 1.1\r\n"
        date = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}"
        yield pa.RecordBatch.from_arrays([pa.array([member(f"{head}\r\n\r\n{info}\r\n\r\n".encode())], pa.binary())], ["value"])
        for batch in batches:
            for i in range(0, len(batch), 64):
                yield pa.RecordBatch.from_arrays([pa.array([member(x.encode() + b"\n") for x in batch.column("value").slice(i, 64).to_pylist()], pa.binary())], ["value"])

    # the text writer ends each row with the byte that member leaves out
    serialised(records).mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("compression", "none").option("lineSep", "\0").text(path)


class Unzipped(io.RawIOBase):
    """The contents of gzip members, piece by piece. Where compressed data breaks the stream ends once (``broken`` counts), then goes on with the next member."""

    MAGIC = b"\x1f\x8b\x08"

    def __init__(self, data: bytes):
        self.data, self.at, self.broken, self.ended = data, 0, 0, False
        self.inflater = zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.ended:
            try:
                piece = self.data[self.at : self.at + (1 << 16)]
                out = self.inflater.decompress(piece, len(buffer))
                used = len(piece) - len(self.inflater.unconsumed_tail or self.inflater.unused_data)
                self.at += used
                if self.inflater.eof:
                    self.next(self.at)
                elif not out and not used:  # cut off
                    raise EOFError
            except (zlib.error, EOFError):
                self.broken += 1
                self.next(self.at + 1)
                return 0
            if out:
                buffer[: len(out)] = out
                return len(out)
        return 0

    def next(self, at: int) -> None:
        """Goes to the next member."""
        found = self.data.find(self.MAGIC, at)
        self.ended, self.at, self.inflater = found < 0, found, zlib.decompressobj(31)


def parsed(data: bytes) -> Iterator[dict]:
    """The records of a WARC file (gzip or plain), one at a time: their headers in lower case, block and state. See the states above."""
    raw = Unzipped(data) if data[:2] == b"\x1f\x8b" else None
    stream = io.BufferedReader(raw, 1 << 16) if raw else io.BytesIO(data)
    line, broken = stream.readline(), 0

    def breaks() -> Iterator[dict]:
        nonlocal broken
        while raw and broken < raw.broken:
            broken += 1
            yield {"block": b"", "state": "unreadable"}

    while True:
        yield from breaks()
        if not line:
            if not raw or raw.ended:
                if not (line := stream.readline()):
                    yield from breaks()
                    return
                continue
            line = stream.readline()
            continue
        if not line.startswith(b"WARC/"):
            line = stream.readline()
            continue
        header = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            header[k.strip().lower()] = v.strip()
        stated = header.get("content-length", "")
        if stated.isascii() and stated.isdigit():
            block = stream.read(min(int(stated), 1 << 40))
            yield header | {"block": block, "state": "whole" if len(block) == int(stated) else "short"}
            line = stream.readline()
        else:
            lines = []
            while (line := stream.readline()) and not line.startswith(b"WARC/"):
                lines.append(line)
            yield header | {"block": b"".join(lines).removesuffix(b"\r\n\r\n"), "state": "no length"}


RESPONSE = SOURCE + ", state string"


def responses_of_files(files: DataFrame, batch_bytes: int = 1 << 23) -> DataFrame:
    """SOURCE rows of the response records in files(content binary), as of spark.read.format("binaryFile"), with their state; the HTTP header goes to headers.

    A row whose state is "unreadable" stands for a break in a file. A task holds its file as it is stored, and decompressed no more than a record and batch_bytes."""
    names = [x.split()[0] for x in RESPONSE.split(", ")]
    kinds = [pa.binary() if " binary" in x else pa.string() for x in RESPONSE.split(", ")]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(names), kinds, strict=True)], names)

    def run(batches):
        for batch in batches:
            for data in batch.column("content"):
                rows, size = [], 0
                for r in parsed(data.as_py() or b""):
                    if r["state"] == "unreadable":
                        rows.append((None,) * (len(names) - 1) + ("unreadable",))
                    elif r.get("warc-type") == "response":
                        head, _, body = r["block"].partition(b"\r\n\r\n")
                        rows.append((r.get("warc-record-id"), r.get("warc-target-uri"), r.get("warc-date"), head.decode("utf-8", "replace"), body, r.get("warc-payload-digest"), r.get("warc-block-digest"), r["state"]))
                        size += len(body)
                    if size > batch_bytes:
                        yield batch_of(rows)
                        rows, size = [], 0
                yield batch_of(rows)

    return files.select("content").mapInArrow(run, RESPONSE)


def responses_of_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """SOURCE rows (without digests, which pages have none of), with page_id, of pages(page_id, url, html); the id is a UUID of the page's id and URL."""
    name = F.md5(F.concat_ws(" ", F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit(""))))
    source_id = F.regexp_replace(name, r"^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "<urn:uuid:$1-$2-3$3-8$4-$5>")
    length = F.coalesce(F.octet_length("html"), F.lit(0))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length.cast("string"))
    return pages.select("page_id", source_id.alias("source_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), headers.alias("headers"), F.col("html").cast("binary").alias("payload"), F.lit(None).cast("string").alias("payload_digest"), F.lit(None).cast("string").alias("block_digest"))


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses_of_pages(table(spark, sf_dir, "pages")), keep=("page_id",))


QUERIES = {"op3_warc_derivatives": op3_warc_derivatives}
ORACLE_SQL: dict[str, str] = {}
