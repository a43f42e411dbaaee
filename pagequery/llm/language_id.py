"""Language identification with hyperdimensional profiles.

Each character has a random vector of ``DIMENSIONS`` signs, drawn from its code point. A trigram binds its three letters, permuted
by their place: roll(a, 2) * roll(b, 1) * c. A text bundles (adds) the vectors of its trigrams, a language those of its training
texts, and a text is compared with the language prototypes by cosine. Letters are Unicode letters, lower-cased, with their marks;
every run of other characters is one space, and a space stands before and after the text.

Training adds one partial bundle a language and task, so what is gathered is tasks x languages x DIMENSIONS numbers in
the shuffle and languages x DIMENSIONS on the driver; ``languages`` bounds their number. Prototypes are centred on their mean, which
removes what all languages share; the plain ones tell how much of a text any of them explains. Unrelated vectors have a cosine of
deviation 1 / sqrt(DIMENSIONS), so a text below three of these is in no language that was learnt, and the filter rejects it.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text where nothing could be learnt.
A null lang is not learnt from, a null doc_id counts as the empty text in the fold. Ties go to the first language by name.
Repeated rows count as often as they occur. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import category, free_name, remainder, table

DIMENSIONS = 1024
UNDETERMINED = "und"
#: Three standard deviations of the cosine of unrelated vectors.
FAR = 3 / math.sqrt(DIMENSIONS)


ASCII_OTHERS = re.compile("[^a-z]+")


@lru_cache(maxsize=1)
def others() -> tuple[re.Pattern, re.Pattern]:
    """Runs of what is neither a letter nor a mark of one, and a letter."""
    return re.compile(f"[^{category('L')}{category('M')}]+"), re.compile(f"[{category('L')}]")



@lru_cache(maxsize=4096)
def letter(code: int) -> np.ndarray:
    return np.random.Generator(np.random.Philox(key=code)).choice(np.array([-1, 1], np.int8), DIMENSIONS)


class Trigrams:
    """Bound vectors of the trigrams met so far; at most ``keep``, then the memory is filled anew."""

    def __init__(self, keep: int = 20_000):
        self.keep = keep
        self.clear()

    def clear(self) -> None:
        self.codes, self.rows, self.vectors, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, DIMENSIONS), np.float32), 0

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        """The rows of vectors for these codes, which are sorted and distinct."""
        at = np.searchsorted(self.codes, codes)
        known = (at < len(self.codes)) & (self.codes[np.minimum(at, max(len(self.codes) - 1, 0))] == codes) if len(self.codes) else np.zeros(len(codes), bool)
        if known.all():
            return self.rows[at]
        if self.n > self.keep:
            self.clear()
            return self(codes)
        new = codes[~known]
        if self.n + len(new) > len(self.vectors):
            grown = np.empty((max(2 * len(self.vectors), self.n + len(new), 1024), DIMENSIONS), np.float32)
            grown[: self.n] = self.vectors[: self.n]
            self.vectors = grown
        for i, code in enumerate(new.tolist()):
            a, b, c = letter(code >> 42), letter(code >> 21 & 0x1FFFFF), letter(code & 0x1FFFFF)
            self.vectors[self.n + i] = np.roll(a, 2) * np.roll(b, 1) * c
        all_codes, all_rows = np.concatenate([self.codes, new]), np.concatenate([self.rows, np.arange(self.n, self.n + len(new))])
        order = np.argsort(all_codes)
        self.codes, self.rows = all_codes[order], all_rows[order]
        self.n += len(new)
        return self(codes)


def letters(text: str | None) -> str:
    """The text's letters and single spaces between them; empty without a letter."""
    if text and text.isascii():
        return ASCII_OTHERS.sub(" ", text.lower()).strip()
    runs, letter_ = others()
    return runs.sub(" ", text.lower()).strip() if text and letter_.search(text) else ""


def trigram_codes(text: str) -> np.ndarray:
    a = np.frombuffer(f" {text} ".encode("utf-32-le"), "<u4").astype(np.int64)
    return a[:-2] << 42 | a[1:-1] << 21 | a[2:]


def bundle(text: str, trigrams: Trigrams) -> np.ndarray:
    codes, n = np.unique(trigram_codes(text), return_counts=True)
    out = np.zeros(DIMENSIONS, np.float32)
    for i in range(0, len(codes), 4096):
        rows = trigrams(codes[i : i + 4096])
        out += n[i : i + 4096].astype(np.float32) @ trigrams.vectors[rows]
    return out


@dataclass
class Profiles:
    """Languages by name, their prototypes of unit length, and the same centred on their mean."""

    names: list[str]
    plain: np.ndarray
    centred: np.ndarray


def prototypes(labelled: DataFrame, languages: int = 10_000) -> Profiles:
    """Learnt from labelled(text, lang); more distinct languages than that are refused."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        trigrams = Trigrams()

        def add(lang: str, texts: list[str]) -> None:
            counted = np.concatenate([trigram_codes(t) for t in texts])
            codes, n = np.unique(counted, return_counts=True)
            total = sums.setdefault(lang, np.zeros(DIMENSIONS))
            for i in range(0, len(codes), 4096):
                rows = trigrams(codes[i : i + 4096])
                total += n[i : i + 4096].astype(np.float32) @ trigrams.vectors[rows]

        for batch in batches:
            held: dict[str, tuple[list[str], int]] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                if text := letters(text):
                    texts, size = held.get(lang, ([], 0))
                    texts.append(text)
                    held[lang] = (texts, size + len(text))
                    if held[lang][1] > 1 << 20:
                        add(lang, held.pop(lang)[0])
            for lang, (texts, _) in held.items():
                add(lang, texts)
        names = [x for x in sums for _ in range(DIMENSIONS)]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(list(range(DIMENSIONS)) * len(sums), pa.int32()), pa.array(np.concatenate(list(sums.values())) if sums else [], pa.float64())], ["lang", "dimension", "part"])

    if (n := labelled.select("lang").distinct().limit(languages + 1).count()) > languages:
        raise ValueError(f"{n} and more languages; lang must be a label of at most {languages} values")
    parts = labelled.select("text", "lang").mapInArrow(run, "lang string, dimension int, part double")
    rows = parts.groupBy("lang", "dimension").agg(F.sum("part").alias("total")).collect()
    names = sorted({r["lang"] for r in rows})
    plain = np.zeros((len(names), DIMENSIONS))
    at = {x: i for i, x in enumerate(names)}
    for r in rows:
        plain[at[r["lang"]], r["dimension"]] = r["total"]
    unit = lambda x: x / np.where((norm := np.sqrt((x**2).sum(1, keepdims=True))) > 0, norm, 1)
    plain = unit(plain)
    return Profiles(names, plain, unit(plain - plain.mean(0)) if len(names) > 1 else plain)


def predicted(documents: DataFrame, profiles: Profiles, lang: str = "lang_pred", score: str = "score", near: str | None = None) -> DataFrame:
    """documents with the columns lang and score; or, if near is named, with the largest cosine to a plain prototype as well, and the text."""
    keep = [c for c in documents.columns if near or c != "text"]
    text_at = documents.columns.index("text")
    names = profiles.names

    def run(batches):
        trigrams = Trigrams()
        for batch in batches:
            best, scores, nearest = [], [], []
            for text in batch.column(text_at).to_pylist():
                text = letters(text)
                vector = bundle(text, trigrams) if text and names else None
                if vector is None or not (size := float(np.sqrt(vector @ vector))):
                    best.append(UNDETERMINED)
                    scores.append(0.0)
                    nearest.append(-1.0)
                    continue
                vector /= size
                cosines = profiles.centred @ vector
                i = int(cosines.argmax())
                best.append(names[i])
                scores.append(min(1.0, max(0.0, float(cosines[i]))))
                nearest.append(float((profiles.plain @ vector).max()) if near else 0.0)
            made = [pa.array(best, pa.string()), pa.array(scores, pa.float64()), *([pa.array(nearest, pa.float64())] if near else [])]
            kept = [c for i, c in enumerate(batch.columns) if near or i != text_at]
            yield pa.RecordBatch.from_arrays([*kept, *made], [*keep, lang, score, *([near] if near else [])])

    made = [StructField(lang, StringType()), StructField(score, DoubleType()), *([StructField(near, DoubleType())] if near else [])]
    return documents.mapInArrow(run, StructType([documents.schema[c] for c in keep] + made))


def learnt(documents: DataFrame, fold: Column) -> Profiles:
    return prototypes(documents.where(~fold & F.col("lang").isNotNull() & F.col("text").isNotNull()))


def identify(documents: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of documents(doc_id, text, lang); a prediction sees the text alone."""
    fold = F.coalesce(remainder(F.col("doc_id"), folds) == held, F.lit(False))
    return predicted(documents.select("doc_id", fold.alias("held_out"), "text"), learnt(documents, fold))


def identified(documents: DataFrame, wanted: tuple[str, ...] | None = None, least: float = FAR, folds: int = 4, held: int = 2) -> DataFrame:
    """The rows of documents in a language that was learnt (wanted: in one of these), other columns as they are.

    Rejected are texts without a letter, and texts whose cosine to every prototype is below least. Where nothing could be learnt, all go."""
    fold = F.coalesce(remainder(F.col("doc_id"), folds) == held, F.lit(False))
    lang, score, near = (free_name(documents, x) for x in ("__pq_lang", "__pq_score", "__pq_near"))
    judged = predicted(documents, learnt(documents, fold), lang, score, near)
    kept = (F.col(lang) != UNDETERMINED) & (F.col(near) >= least)
    return judged.where(kept & F.col(lang).isin(*wanted) if wanted is not None else kept).drop(lang, score, near)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {"op8_language_id": op8_language_id}
ORACLE_SQL: dict[str, str] = {}
