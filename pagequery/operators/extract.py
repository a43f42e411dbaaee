"""Values beside keywords.

The compact language walks over lines and words as far as a pattern says, which takes a program a page: it runs on Arrow batches,
once for all patterns, whose keywords are one automaton (``functions.keywords``), and yields rows of matches. Pages that can hold no keyword are filtered out before
where there are few. Which pages are searched, which matches are taken, trimming and the columns of
variables are built-in functions around it; patterns that are taken and trimmed alike share one expression, so that a plan does not grow with their number. The four-part language is expressed in column functions throughout."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequery.functions.keywords import Phrases
from pagequery.functions.text import join_or_null, lines, trim_ws, words
from pagequery.functions.trimming import trim
from pagequery.plans.compact import LegacyPattern, Pattern, Pick

NO_MATCH = "No_Match"
NUMBER = re.compile(r"-?\d+(?:[.,]\d+)*")
FEW = 32  # keyword words that a filter of built-in functions looks for
BLOCK_CHARACTERS = 20_000_000  # of keywords in one automaton
#: What a move adds to the line and to the word.
STEP = {"u": (-1, 0), "d": (1, 0), "l": (0, -1), "r": (0, 1)}


def bare(word: str) -> str:
    """A word's letters and digits, in lower case."""
    return "".join(filter(str.isalnum, word.lower()))


@lru_cache(maxsize=8)
def phrases_of(keywords: tuple[str, ...]) -> Phrases:
    """One a Python process: tasks that follow one another keep what they have read."""
    return Phrases([*keywords], bare)


class Page:
    """A page's lines, their words, and the keywords in them."""

    def __init__(self, text: str, phrases: Phrases):
        self.lines = text.split("\n")
        self.words = [*map(str.split, self.lines)]
        self.phrases = phrases

    def found(self) -> Iterator[tuple[int, int, int, str]]:
        """(keyword, line, place of the last word, matched words) wherever consecutive words of a line contain a keyword's."""
        for i, have in enumerate(self.words):
            for k, first, last in self.phrases.in_line(have):
                yield k, i, last, " ".join(have[first : last + 1])

    def target(self, line: int, word: int, moves) -> tuple[int, int] | None:
        """Where the moves lead, held within the page and then within the line; a line that is come to from above or below is entered at its start."""
        for way, n in moves:
            down, right = STEP[way]
            line = min(max(line + n * down, 0), len(self.lines) - 1)
            word = 0 if down else min(max(word + n * right, 0), len(self.words[line]) - 1)
        return (line, word) if 0 <= word < len(self.words[line]) else None

    def content(self, line: int, word: int, p: Pattern) -> str | None:
        return taken(self.lines, line, word, p)


def taken(page: list[str], line: int, word: int, p: Pattern) -> str | None:
    """The content at a place: words, lines or numbers, as many as the pattern says; a flexible one goes on in the next lines."""
    if p.kind == "ln":
        part = page[line:] if p.count == 0 else page[line : line + p.count]
        if p.flexible and p.count:
            part = [x for x in part if x.strip()]
        return "\n".join(part) if part else None
    rest = page[line].split()[word:]
    if p.count == 0:
        if p.kind == "wd":
            return " ".join(rest) or None
        found: list[str] = []
        for w in rest:
            if not (numbers := NUMBER.findall(w)):
                break
            found += numbers
        return " ".join(found) or None
    found = []
    for i in range(line, len(page) if p.flexible else line + 1):
        for w in rest if i == line else page[i].split():
            found += [w] if p.kind == "wd" else NUMBER.findall(w)
            if len(found) >= p.count:
                return " ".join(found[: p.count])
    return " ".join(found) or None


def page_matches(text: str | None, patterns: list[Pattern], phrases: Phrases | None = None) -> list[tuple[int, int, int, str, str | None]]:
    """(pattern, line, word, matched words, content) of one page."""
    if not (text or "").strip():
        return []
    page = Page(text, phrases or phrases_of(tuple(p.keyword for p in patterns)))
    out = []
    for k, line, word, matched in page.found():
        to = page.target(line, word, patterns[k].moves)
        out.append((k, line, word, matched, page.content(*to, patterns[k]) if to else None))
    return sorted(out, key=lambda m: m[:3])


MATCH = "pattern int, line int, word int, match_text string, extracted string"


def may_match(text: Column, keywords: list[str]) -> Column | None:
    """A filter by built-in functions that no page with a keyword fails; None where there are too many keywords, or one is in any word.

    Signs may stand between a keyword's letters. Texts beyond ASCII pass, since their letters change case by tables of their own."""
    parts = {bare(w) for k in keywords for w in k.split()[:1]}
    if len(parts) > FEW or not all(p.isascii() and p for p in parts):
        return None
    pattern = "(?i)" + "|".join(r"[^\p{L}\p{N}\s]*".join(p) for p in sorted(parts))
    return (F.octet_length(text) != F.char_length(text)) | text.rlike(pattern)


def blocks_of(patterns: list[Pattern]) -> list[list[tuple[int, Pattern]]]:
    """The numbered patterns in blocks of keywords that one automaton holds."""
    out, size = [[]], 0
    for k, p in enumerate(patterns):
        size += len(p.keyword)
        if size > BLOCK_CHARACTERS and out[-1]:
            out, size = [*out, []], len(p.keyword)
        out[-1].append((k, p))
    return out


def matches(pages: DataFrame, patterns: list[Pattern], labels: dict[str, list[int]] | None = None) -> DataFrame:
    """doc_id, page_no, pattern, line, word, match_text, extracted: each match of each pattern on each page, in one pass over the pages.

    labels: columns with a number for each pattern, which its matches get."""
    labels = labels or {}
    found = [_matches(pages, block, labels) for block in blocks_of(patterns)]
    return reduce(DataFrame.unionByName, found)


def _matches(pages: DataFrame, block: list[tuple[int, Pattern]], labels: dict[str, list[int]]) -> DataFrame:
    shared = pages.sparkSession.sparkContext.broadcast(([k for k, _ in block], [p for _, p in block], [[x[k] for k, _ in block] for x in labels.values()]))
    schema = MATCH + "".join(f", {x} int" for x in labels)
    names = ["doc_id", "page_no", *(x.split()[0] for x in schema.split(", "))]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()] + [pa.int32()] * len(labels)

    def run(batches):
        numbers, patterns, labelled = shared.value
        phrases = phrases_of(tuple(p.keyword for p in patterns))
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for k, *m in page_matches(text, patterns, phrases):
                    at.append(i)
                    found.append((numbers[k], *m, *(x[k] for x in labelled)))
            at = pa.array(at, pa.int64())
            columns = zip(*found, strict=True) if found else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("page_no").take(at), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    kind = pages.schema["doc_id"].dataType.simpleString()
    hopeful = may_match(F.col("text"), [p.keyword for _, p in block])
    searched = pages if hopeful is None else pages.where(hopeful)
    return searched.select("doc_id", "page_no", "text").mapInArrow(run, f"doc_id {kind}, page_no int, {schema}")


def in_pick(place: Column, n: Column, pick: Pick) -> Column:
    """Whether the place (from 1) of n is picked."""
    if pick.kind == "all":
        return F.lit(True)
    if pick.kind == "single":
        return place == pick.a
    if pick.kind == "last":
        return place > n - pick.a
    if pick.kind == "from":
        return place >= pick.a
    return place.between(pick.a, pick.b)


def extract(pages: DataFrame, patterns: list[Pattern], source_page: int = 1) -> DataFrame:
    """doc_id, pattern, variable, success, n_matches, selected (trimmed contents in order), warnings: a row for each document and pattern.

    A pattern without pages looks at source_page, one without matches takes the first."""
    asked = [p.pages or Pick("single", source_page) for p in patterns]
    taking = [(p.matches or Pick("single", 1), p.no_spaces, p.start, p.end) for p in patterns]
    picks, shapes = list(dict.fromkeys(asked)), list(dict.fromkeys(taking))
    last = any(q.kind == "last" for q in picks)
    searched = pages.withColumn("__n", F.max("page_no").over(Window.partitionBy("doc_id")) if last else F.lit(0))
    wanted = F.array(*(F.when(in_pick(F.col("page_no"), F.col("__n"), q), k) for k, q in enumerate(picks)))
    searched = searched.withColumn("__wanted", F.array_compact(wanted)).where(F.size("__wanted") > 0)
    of_page = searched.select("doc_id", "page_no", "__wanted")
    rows = matches(searched, patterns, {"__pick": [*map(picks.index, asked)], "__shape": [*map(shapes.index, taking)]})
    if len(picks) > 1:  # patterns look at different pages
        rows = rows.join(of_page, ["doc_id", "page_no"]).where(F.array_contains("__wanted", F.col("__pick")))
    order = Window.partitionBy("doc_id", "pattern").orderBy("page_no", "line", "word")
    whole = Window.partitionBy("doc_id", "pattern")
    rows = rows.withColumns({"place": F.row_number().over(order), "n": F.count(F.lit(1)).over(whole)})
    picked, out = F.lit(False), F.col("extracted")
    value = F.lit(None).cast("string")
    for k, (pick, no_spaces, start, end) in enumerate(shapes):
        of = F.col("__shape") == k
        picked = picked | (of & in_pick(F.col("place"), F.col("n"), pick))
        v = F.regexp_replace(out, r"(?U)\s+", "") if no_spaces else out
        value = F.when(of, trim(v, start, end)).otherwise(value)
    chosen = rows.withColumn("value", F.when(picked, F.struct("place", value.alias("v"))))
    per = chosen.groupBy("doc_id", "pattern").agg(F.array_sort(F.collect_list("value")).alias("c"), F.max("n").alias("n_matches"))
    names = pages.sparkSession.createDataFrame([(k, p.variable, p.keyword) for k, p in enumerate(patterns)], "pattern int, variable string, keyword string")
    numbered = pages.select("doc_id").distinct().select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(len(patterns) - 1))).alias("pattern"))
    joined = numbered.join(F.broadcast(names), "pattern").join(per, ["doc_id", "pattern"], "left").withColumn("n_matches", F.coalesce(F.col("n_matches").cast("int"), F.lit(0)))
    selected = F.coalesce(F.transform("c", lambda x: x["v"]), F.array().cast("array<string>"))
    warned = F.when(F.col("n_matches") == 0, F.array(F.concat(F.lit("keyword '"), "keyword", F.lit("' not found")))).when(F.size(selected) == 0, F.array(F.lit("no such match"))).when(F.size(selected) > 1, F.array(F.lit("several matches"))).otherwise(F.array().cast("array<string>"))
    return joined.select("doc_id", "pattern", "variable", (F.size(selected) > 0).alias("success"), "n_matches", selected.alias("selected"), warned.alias("warnings"))


def debug(pages: DataFrame, pattern: Pattern) -> DataFrame:
    """doc_id, page_no, line, word, match_text, line_text, target (line and word after the moves, null if outside), extracted: how each match came about."""

    def run(batches):
        names = ["doc_id", "page_no", "line", "word", "match_text", "line_text", "target_line", "target_word", "extracted"]
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                page = Page(text or "", phrases_of((pattern.keyword,)))
                for _, line, word, matched in page.found():
                    to = page.target(line, word, pattern.moves)
                    at.append(i)
                    rows.append((line, word, matched, page.lines[line], *(to or (None, None)), page.content(*to, pattern) if to else None))
            at = pa.array(at, pa.int64())
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("page_no").take(at), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    kind = pages.schema["doc_id"].dataType.simpleString()
    return pages.select("doc_id", "page_no", "text").mapInArrow(run, f"doc_id {kind}, page_no int, line int, word int, match_text string, line_text string, target_line int, target_word int, extracted string")


def variables(pages: DataFrame, patterns: list[Pattern], source_page: int = 1) -> DataFrame:
    """doc_id and a column for each variable: its first selected content, No_Match without one."""
    rows = extract(pages, patterns, source_page)
    value = F.when(F.col("success"), F.get("selected", F.lit(0))).otherwise(NO_MATCH)
    return rows.groupBy("doc_id").agg(*(F.max(F.when(F.col("pattern") == k, value)).alias(p.variable) for k, p in enumerate(patterns)))


def page_count_of(pages: DataFrame, pick: Pick) -> DataFrame:
    """The pages of a page specification."""
    n = F.max("page_no").over(Window.partitionBy("doc_id"))
    return pages.withColumn("__n", n).where(in_pick(F.col("page_no"), F.col("__n"), pick)).drop("__n")


# --- the four-part language, in column functions ---------------------------------------------------------------------

POSITION = "struct<line:int,word:int,last:int>"


def keyword_position(text: Column, keyword: str) -> Column:
    """line, word, last: the first line that contains the keyword in any case, and the words where it starts and ends; null without one.

    Places are counted as if words stood one space apart."""

    def in_line(line: Column, i: Column) -> Column:
        start = F.locate(keyword.lower(), F.lower(line)) - 1
        have = words(line)
        ends = F.transform(have, lambda _, j: F.length(F.array_join(F.slice(have, 1, j + 1), " ")))
        first = F.size(F.filter(ends, lambda e: e + 1 <= start))
        last = F.size(F.filter(ends, lambda e: e + 1 < start + len(keyword)))
        return F.when((start >= 0) & (last < F.size(have)), F.struct(i.cast("int").alias("line"), first.cast("int").alias("word"), last.cast("int").alias("last")))

    return F.get(F.array_compact(F.transform(lines(text), in_line)), F.lit(0))


def legacy_value(text: Column, p: LegacyPattern) -> Column:
    """The value beside a keyword; null where the keyword or the place is missing."""
    text = F.coalesce(text, F.lit(""))
    at, page = keyword_position(text, p.keyword), lines(text)
    vertical = p.direction in ("above", "below")
    line = at["line"] + (p.distance if p.direction == "below" else -p.distance if p.direction == "above" else 0)
    word = F.lit(0) if vertical else at["last"] + p.distance + 1 if p.direction == "right" else at["word"] - p.distance
    to = F.when((line >= 0) & (line < F.size(page)) & (word >= 0), F.struct(F.get(page, line).alias("line"), word.alias("word")))

    def value(t: Column) -> Column:
        have = words(t["line"])
        n, w = F.size(have), t["word"]
        inside = (n > 0) if p.direction != "right" else (w < n)
        if p.kind == "line":
            out = trim_ws(t["line"])
        elif p.kind == "word":
            out = F.get(have, w)
        elif p.kind == "text":
            out = join_or_null(F.slice(have, w + 1, F.greatest(n - w, F.lit(0))), " ")
        else:
            near = F.slice(have, w + 1, F.greatest(F.least(F.lit(3), n - w), F.lit(0)))
            out = F.get(F.filter(F.transform(near, lambda x: F.regexp_extract(x, r"(?U)-?\d+(?:[.,]\d+)*", 0)), lambda x: x != ""), F.lit(0))
        return F.when(inside, out)

    return F.get(F.transform(F.array_compact(F.array(to)), value), F.lit(0))


def legacy_matches(pages: DataFrame, keyword: str) -> DataFrame:
    """doc_id, page_no, line, word_index, word of each word that contains the keyword in any case."""
    per_line = pages.select("doc_id", "page_no", F.posexplode(lines(F.coalesce("text", F.lit("")))).alias("line", "t"))
    per_word = per_line.select("doc_id", "page_no", "line", F.posexplode(words(F.col("t"))).alias("word_index", "word"))
    return per_word.where(F.contains(F.lower("word"), F.lit(keyword.lower())))


@lru_cache(maxsize=8)
def lowered_phrases(keywords: tuple[str, ...]) -> Phrases:
    return Phrases([*keywords], str.lower)


def legacy_matches_of(pages: DataFrame, keywords: list[str]) -> DataFrame:
    """The same for any number of keywords without white space, in one pass, with keyword (as given)."""
    if any(k.split() != [k] for k in keywords):
        raise ValueError("keywords are single words")
    shared = pages.sparkSession.sparkContext.broadcast(tuple(keywords))
    names, kinds = ["line", "word_index", "word", "keyword"], [pa.int32(), pa.int32(), pa.string(), pa.string()]

    def run(batches):
        phrases = lowered_phrases(shared.value)
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for n, line in enumerate((text or "").split("\n")):
                    have = line.split()
                    for k, place, _ in phrases.in_line(have):
                        at.append(i)
                        rows.append((n, place, have[place], shared.value[k]))
            at = pa.array(at, pa.int64())
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("page_no").take(at), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "page_no", *names])

    kind = pages.schema["doc_id"].dataType.simpleString()
    return pages.select("doc_id", "page_no", "text").mapInArrow(run, f"doc_id {kind}, page_no int, line int, word_index int, word string, keyword string")


def legacy_debug(text: Column, p: LegacyPattern) -> Column:
    """keyword_found, position and value of a four-part pattern."""
    at = keyword_position(F.coalesce(text, F.lit("")), p.keyword)
    return F.struct(at.isNotNull().alias("keyword_found"), at.alias("position"), legacy_value(text, p).alias("value"))


def scrape(pages: DataFrame, patterns: dict[str, LegacyPattern]) -> DataFrame:
    """filename, page and a column for each pattern, of the pages where one matched at least; what did not match is empty."""
    out = pages.select(F.col("doc_id").alias("filename"), F.col("page_no").alias("page"), *(legacy_value(F.col("text"), p).alias(name) for name, p in patterns.items()))
    hit = reduce(lambda a, b: a | b, (F.col(f"`{n}`").isNotNull() for n in patterns))
    return out.where(hit).select("filename", "page", *(F.coalesce(f"`{n}`", F.lit("")).alias(n) for n in patterns))
