"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs are the blocks of a text between blank lines. Each line of a block is judged, and a block of several lines (up to ``BLOCK_LINES``
in one piece; longer ones in windows of so many, half overlapping) as a whole, so a notice is found on a line of its own as well as a licence that is wrapped
over many. A line stands for itself where its prediction is confirmed; a block where it is confirmed and none of its lines is.

The classifier is a multinomial logistic regression over the word 1- and 2-grams of the
templates (no other word can speak for a licence), made sparse by an L1 penalty, with a class of its own for paragraphs that are
no licence. It is trained from variants of the templates and from a bounded sample of lines of the corpus
(``sample_rows`` of least hash, of about ``sample_documents`` documents by hash, among those that share a word with a template, are like none of them and are no part of one). A temperature
calibrates its probabilities: it is fitted on whole templates that a trial fit has not seen, in any variant, and on lines held out. A licence family is predicted where its
probability is over one half; the prediction is confirmed where some template of the family shares ``similar`` or more of its
2-grams with the paragraph.

Everything that touches all texts is built-in functions. A paragraph without any n-gram of positive weight scores no more than
the biases, and the fit makes sure that this is unknown; so texts are first searched for the words of such n-grams.

Defined results: null and empty texts give no row; a paragraph of any length is judged; equal paragraphs give rows of their own. Equal probabilities go to the
family that stands first in ``TEMPLATES``. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ROW, hashed_sample, numbered, settled, table

#: Notices by which texts name their licence, and paragraphs of the licences (fixed texts).
TEMPLATES = {
    "MIT": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.", "Released under the MIT License.", "This project is licensed under the terms of the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "MIT licensed"],
    "Apache": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", "Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the Apache License", "Distributed under the Apache License 2.0"],
    "GPL": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.", "This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "Released under the GPL version 2 or any later version"],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "You should have received a copy of the GNU Lesser General Public License along with this library.", "Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License"],
    "AGPL": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "Licensed under the GNU Affero General Public License, version 3.", "Released under the AGPL version 3"],
    "BSD": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD 3-Clause License.", "Released under the 2-clause BSD license", "BSD license"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Available under the Creative Commons Attribution License"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.", "Released under CC0 1.0 Universal", "Dedicated to the public domain under the Creative Commons CC0 Public Domain Dedication"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License."],
    "Proprietary": ["All rights reserved.", "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.", "Unauthorised copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."],
}
UNKNOWN = "unknown"
BLOCK_LINES = 64


def grams(text: str) -> list[str]:
    w = [x for x in re.split(r"[\W_]+", text.lower()) if x]
    return sorted(set(w) | {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def bigrams(text: str) -> list[str]:
    return [g for g in grams(text) if " " in g] or grams(text)


def strings(values) -> Column:
    """A constant array, of one literal."""
    return F.split(F.lit("\x1f".join(values)), "\x1f")


def doubles(values) -> Column:
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def grams_of(words: Column) -> Column:
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(words, pairs))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


@dataclass
class Model:
    families: list[str]
    vocabulary: list[str]
    weights: np.ndarray  # of (n-gram, family or unknown)
    bias: np.ndarray
    temperature: float = 1.0
    common: list[str] = field(default_factory=list)  # the words of the vocabulary, commonest first

    def logits(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.weights + self.bias) / self.temperature

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.logits(x)
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def anchors(self) -> list[str]:
        """Words of which one at least is in every paragraph that a family is predicted for.

        The other words are so weak that all n-grams made of them alone do not lift any family above unknown; the commonest are
        tried first, so that the search is for rare words."""
        gain = np.maximum(self.weights[:, :-1] - self.weights[:, -1:], 0)
        lead = self.bias[-1] - self.bias[:-1]
        parts = [set(g.split(" ")) for g in self.vocabulary]
        weak: set[str] = set()
        for word in self.common:
            within = np.array([p <= weak | {word} for p in parts])
            if (gain[within].sum(0) < lead).all():
                weak.add(word)
        return sorted({w for p in parts for w in p} - weak)


def variants() -> list[tuple[str, str, bool]]:
    """(text, family, whether its template is held out of the trial): the templates, and each with words lost at its ends, in capitals, and within a sentence."""
    out = []
    for family, texts in TEMPLATES.items():
        for number, t in enumerate(texts):
            w, held = t.split(), number % 3 == 2
            out += [(x, family, held) for x in (t, t.upper(), f"Copyright 2020. {t}", f"{t} See the file for details.")]
            out += [(" ".join(w[a : len(w) - b]), family, held) for a, b in ((1, 0), (0, 1), (2, 0), (1, 1), (0, len(w) // 2), (len(w) // 2, 0)) if len(w) - a - b >= 4]
    return out


def fit(negatives: list[list[str]], penalty: float = 2e-4, steps: int = 400) -> Model:
    """negatives: the n-grams of paragraphs that are no licence."""
    positive = variants()
    vocabulary = sorted({g for texts in TEMPLATES.values() for t in texts for g in grams(t)})
    families = [*TEMPLATES, UNKNOWN]
    at = {g: i for i, g in enumerate(vocabulary)}
    # nothing of a template, each common word alone, and what the corpus shows
    none = [[], *([g] for g in vocabulary if " " not in g), *negatives]
    rows = [(grams(t), families.index(f), held) for t, f, held in positive] + [(g, len(families) - 1, i % 4 == 3) for i, g in enumerate(none)]
    x, y = np.zeros((len(rows), len(vocabulary))), np.zeros((len(rows), len(families)))
    for i, (g, k, _) in enumerate(rows):
        x[i, [at[v] for v in g if v in at]] = 1
        y[i, k] = 1
    share = y.sum(0)
    weight = (y / np.sqrt(share)).sum(1)
    held = np.array([x for *_, x in rows])

    def solve(use: np.ndarray) -> Model:
        xs, ys, ws = x[use], y[use], weight[use, None] / weight[use].sum()
        m = Model(families, vocabulary, np.zeros((len(vocabulary), len(families))), np.zeros(len(families)))
        rate = 4.0 / max((ws * xs**2).sum(1).max() * len(ws), (ws * (xs**2).sum(1, keepdims=True)).sum() / 2)
        look, look_bias, t = m.weights.copy(), m.bias.copy(), 1.0
        for _ in range(steps):  # accelerated proximal steps
            z = xs @ look + look_bias
            p = np.exp(z - z.max(1, keepdims=True))
            g = ws * (p / p.sum(1, keepdims=True) - ys)
            new = look - rate * (xs.T @ g)
            new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
            new_bias = look_bias - rate * g.sum(0)
            t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
            look, look_bias = new + (before - 1) / t * (new - m.weights), new_bias + (before - 1) / t * (new_bias - m.bias)
            m.weights, m.bias = new, new_bias
        m.bias[-1] = max(m.bias[-1], m.bias[:-1].max())  # a paragraph with no n-gram in favour is unknown; before the calibration, which knows it
        return m

    trial = solve(~held)  # its mistakes on what it has not seen set the temperature
    z, yh = trial.logits(x[held]), y[held]

    def loss(temperature: float) -> float:
        s = z / temperature
        return float((np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - (s * yh).sum(1)).mean())

    best = min(np.geomspace(0.25, 8, 41).tolist(), key=loss)
    model = solve(np.ones(len(rows), bool))
    model.temperature = float(best)
    seen = Counter(w for g in negatives for w in g if " " not in w)
    model.common = sorted((w for w in vocabulary if " " not in w), key=lambda w: (-seen[w], len(w), w))
    return model


def like_a_template(gram_array: Column, families: list[str], family: Column | None = None) -> Column:
    """The largest share of a template's 2-grams that the paragraph has, over the templates of the family (or of all)."""
    best = F.lit(0.0)
    for f in families:
        of = F.greatest(*(F.size(F.array_intersect(gram_array, strings(bigrams(t)))) / len(bigrams(t)) for t in TEMPLATES[f]), F.lit(0.0))
        best = F.when(family == f, of).otherwise(best) if family is not None else F.greatest(best, of)
    return best


def part_of_a_template(gram_array: Column) -> Column:
    """Whether two or more 2-grams, and all of them, are one template's."""
    pairs = F.filter(gram_array, lambda g: g.contains(" "))
    within = (F.size(F.array_except(pairs, strings(bigrams(t)))) == 0 for texts in TEMPLATES.values() for t in texts)
    return (F.size(pairs) >= 2) & F.array_max(F.array(*within))


def has_word(text: Column, anchors: list[str]) -> Column:
    return F.arrays_overlap(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), strings(anchors))


def lines_of(documents: DataFrame, anchors: list[str]) -> DataFrame:
    """doc_id, line (from 0), text of the lines with one of these words."""
    some = documents.select("doc_id", "text").where(has_word(F.col("text"), anchors))
    lines = some.select("doc_id", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("line", "text"))
    return lines.where(has_word(F.col("text"), anchors))


def paragraphs(documents: DataFrame, anchors: list[str]) -> DataFrame:
    """row, doc_id, paragraph (from 0), line (within it, from 0; -1 for the whole or a window of it), text, of those with one of these words."""
    some = numbered(documents, "doc_id", "text").where(has_word(F.col("text"), anchors))
    blocks = some.select(ROW, "doc_id", F.posexplode(F.split(F.regexp_replace("text", r"\r\n|\r", "\n"), r"\n(?:[ \t]*\n)+")).alias("paragraph", "block"))
    blocks = blocks.where(has_word(F.col("block"), anchors)).select(ROW, "doc_id", "paragraph", F.split("block", "\n").alias("lines"))
    half = BLOCK_LINES // 2
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("lines") - half - 1), F.lit(half))
    windows = F.when(F.size("lines") > 1, F.transform(starts, lambda i: F.struct(F.lit(-1).alias("line"), F.array_join(F.slice("lines", i + 1, F.lit(BLOCK_LINES)), " ").alias("text"))))
    single = F.transform("lines", lambda t, i: F.struct(i.alias("line"), t.alias("text")))
    units = F.concat(single, F.coalesce(windows, F.array().cast("array<struct<line:int,text:string>>")))
    out = blocks.select(ROW, "doc_id", "paragraph", F.explode(units).alias("u")).select(ROW, "doc_id", "paragraph", "u.line", "u.text")
    return out.where(has_word(F.col("text"), anchors))


def template_words() -> list[str]:
    """The words by which a paragraph enters the sample of the corpus: those of four letters or more."""
    return sorted({w for texts in TEMPLATES.values() for t in texts for w in grams(t) if " " not in w and len(w) >= 4})


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that is computed once a row, however often it is used: a filter or projection above is not merged through a generator."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def train(documents: DataFrame, sample_rows: int = 2000, sample_documents: int = 20_000) -> Model:
    total, scale = documents.count(), 1 << 30
    if total > sample_documents:
        documents = documents.where(F.pmod(F.xxhash64("text"), F.lit(scale)) < scale * sample_documents // total)
    vocabulary = sorted({g for texts in TEMPLATES.values() for t in texts for g in grams(t)})
    shown = once(lines_of(documents, template_words()), "all", grams_of(words_of(F.col("text"))))
    shown = once(shown, "g", F.array_sort(F.array_intersect("all", strings(vocabulary))))
    shown = shown.select("g", (F.size("g") == F.size("all")).alias("whole")).distinct().where(like_a_template(F.col("g"), list(TEMPLATES)) < 0.5)
    shown = shown.where(~(F.col("whole") & part_of_a_template(F.col("g")))).select("g").distinct()
    return fit([r["g"] for r in hashed_sample(shown, sample_rows)])


def scan(documents: DataFrame, sample_rows: int = 2000, similar: float = 0.6, model: Model | None = None, sample_documents: int = 20_000) -> DataFrame:
    """doc_id, paragraph, line, family, probability, similarity, confirmed: the lines and blocks of documents(doc_id, text) that a licence family is predicted for."""
    documents = settled(documents)
    model = model or train(documents, sample_rows, sample_documents)
    kept = np.nonzero(np.abs(model.weights).max(1) > 0)[0]
    vocabulary = strings(model.vocabulary[i] for i in kept)
    df = once(paragraphs(documents, model.anchors()), "g", grams_of(words_of(F.col("text"))))
    df = once(df, "at", F.transform(F.array_intersect("g", vocabulary), lambda g: F.array_position(vocabulary, g).cast("int")))

    def logit(k: int) -> Column:
        weights = doubles(model.weights[kept, k])
        return F.aggregate("at", F.lit(float(model.bias[k])), lambda s, i: s + F.get(weights, i - 1)) / model.temperature

    logits = [logit(k) for k in range(len(model.families))]
    df = once(once(df, "z", F.array(*logits)), "top", F.array_max("z"))
    p = 1 / F.aggregate("z", F.lit(0.0), lambda s, z: s + F.exp(z - F.col("top")))
    family = F.get(strings(model.families), F.array_position("z", F.col("top")).cast("int") - 1)
    df = once(once(df, "family", family), "probability", p).where((F.col("family") != UNKNOWN) & (F.col("probability") > 0.5))
    df = df.withColumn("similarity", like_a_template(F.col("g"), list(TEMPLATES), F.col("family"))).withColumn("confirmed", F.col("similarity") >= similar)
    df = df.select(ROW, "doc_id", "paragraph", "line", "family", F.round("probability", 6).alias("probability"), F.round("similarity", 6).alias("similarity"), "confirmed")
    # of a paragraph, the confirmed lines; without any, the best confirmed window of it; without that, the lines that are predicted
    whole = Window.partitionBy(ROW, "paragraph")
    line, block = (F.max(F.col("confirmed") & ((F.col("line") >= 0) == F.lit(x))).over(whole) for x in (True, False))
    best = F.row_number().over(Window.partitionBy(ROW, "paragraph", "line").orderBy(F.desc("similarity"), F.desc("probability"), "family"))
    df = df.withColumns({"by_line": line, "by_block": block & ~line, "best": best})
    keep = F.when(F.col("by_line"), F.col("line") >= 0).when(F.col("by_block"), (F.col("line") == -1) & (F.col("best") == 1)).otherwise(F.col("line") >= 0)
    return df.where(keep).select("doc_id", "paragraph", "line", "family", "probability", "similarity", "confirmed")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op6_license_scan": op6_license_scan}
ORACLE_SQL: dict[str, str] = {}
