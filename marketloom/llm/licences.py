"""License scan: TF-IDF cosine to templates, then inheritance from the nearest licence file above.

Sentences of every text that hold words of the templates are compared with the templates by the
cosine of their sparse TF-IDF vectors; the best one above a threshold is the document's own licence.
A document that consists of little else, or has the name of one, is a licence file of its
directory. Documents without a licence of their own take that of the nearest directory above them:
only distinct directories are joined with their ancestors.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .words import blocks

#: Notices as they stand in headers, by SPDX identifier (fixed, public texts).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", "Released under the ISC License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC0-1.0", "Released under the CC0 1.0 Universal public domain dedication."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved. Proprietary and confidential."),
)
_TERM = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
_SENTENCE = re.compile(r"(?<=[.!?;])\s+|\n+")
#: Words of the templates that do not tell on their own that a sentence is about a licence.
_PLAIN = frozenset("the of is this and into to all by under form terms work version source code subject public free general other reserved released 1.0 2.0 2.1 3 2 4.0".split())
_FILE_NAME = r"(?i)(?:^|/)(?:licen[cs]e|copying|unlicense|notice)(?:[.-][^/]*)?$"


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


def _core(found: list[str], vocabulary: frozenset[str], telling: frozenset[str]) -> list[str]:
    """The words from the first telling one to the last, and the words of the vocabulary next to them."""
    at = [i for i, w in enumerate(found) if w in telling]
    if not at:
        return []
    first, last = at[0], at[-1]
    while first and found[first - 1] in vocabulary:
        first -= 1
    while last + 1 < len(found) and found[last + 1] in vocabulary:
        last += 1
    return found[first : last + 1]


def notices(docs: DataFrame, vocabulary: frozenset[str]) -> DataFrame:
    """Per row of `doc_id, path, text` the words of the vocabulary in it, its number of words, and its candidates.

    A candidate is the part of a sentence around telling words of the vocabulary, with one more word of it at least.
    """
    telling, numbers = vocabulary - _PLAIN, {w: i for i, w in enumerate(sorted(vocabulary))}
    anchor = re.compile("|".join(map(re.escape, sorted(telling))), re.IGNORECASE)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has, n, candidates = [], [], []
            for text in batch.column(2):
                seen, size, own = set(), 0, []
                for block in blocks(text.as_py()):
                    parts = block.split()
                    size += len(parts)
                    seen.update(vocabulary.intersection(p.strip(".,;:!?\"'()#*$%&").lower() for p in set(parts)))
                    if anchor.search(block) is not None:
                        cores = (_core(terms(s), vocabulary, telling) for s in _SENTENCE.split(block) if anchor.search(s) is not None)
                        own += [c for c in cores if len(vocabulary.intersection(c)) > 1]
                has.append(sorted(numbers[w] for w in seen))
                n.append(size)
                candidates.append(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(has, pa.list_(pa.int32())), pa.array(n, pa.int32()), pa.array(candidates, pa.list_(pa.list_(pa.string())))],
                names=["doc_id", "path", "has", "n_words", "candidates"],
            )

    return docs.select("doc_id", "path", "text").mapInArrow(find, "doc_id long, path string, has array<int>, n_words int, candidates array<array<string>>")


class Cosine:
    """TF-IDF vectors of the templates; words outside the vocabulary weigh as those that no document has."""

    def __init__(self, templates: tuple[tuple[str, str], ...], counts: dict[str, int], n: int):
        self.rare = math.log(n + 1) + 1
        self.idf = {w: math.log((n + 1) / (c + 1)) + 1 for w, c in counts.items()}
        self.templates = [(name, self.vector(terms(text))) for name, text in templates]

    def vector(self, found: list[str]) -> dict[str, float]:
        raw = {w: k * self.idf.get(w, self.rare) for w, k in Counter(found).items()}
        norm = math.sqrt(sum(x * x for x in raw.values())) or 1.0
        return {w: x / norm for w, x in raw.items()}

    def best(self, found: list[str]) -> tuple[float, str]:
        own = self.vector(found)
        return min(((-sum(x * t.get(w, 0.0) for w, x in own.items()), name) for name, t in self.templates), default=(0.0, ""))


def own_licences(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = 0.75) -> DataFrame:
    """`doc_id, path, licence, score, is_file` per row; licence and score are null where no template is near.

    The counts of the vocabulary are taken over all rows. Of equal scores the first name wins. A licence
    file has a name of one, or words of its notice make up half of it.
    """
    vocabulary = frozenset(w for _, text in templates for w in terms(text))
    scanned = materialise(notices(docs, vocabulary))
    words = sorted(vocabulary)
    counted = scanned.select(F.explode("has").alias("w")).groupBy("w").count().collect()  # at most a row for each word of the templates
    cosine = Cosine(templates, {w: 0 for w in words} | {words[r["w"]]: r["count"] for r in counted}, scanned.count())
    sent = docs.sparkSession.sparkContext.broadcast(cosine)

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            best = [min(((*sent.value.best(list(c)), len(c)) for c in own), default=(0.0, "", 0)) for own in frame.pop("candidates")]
            near = [-b[0] >= threshold for b in best]
            yield frame.assign(
                licence=[b[1] if ok else None for b, ok in zip(best, near, strict=True)], score=[-b[0] if ok else None for b, ok in zip(best, near, strict=True)],
                filled=[ok and 2 * b[2] >= n for b, ok, n in zip(best, near, frame["n_words"], strict=True)],
            )[["doc_id", "path", "licence", "score", "filled"]]

    judged = scanned.select("doc_id", "path", "n_words", "candidates").mapInPandas(judge, "doc_id long, path string, licence string, score double, filled boolean")
    return judged.select("doc_id", "path", "licence", "score", (F.col("licence").isNotNull() & (F.col("filled") | F.col("path").rlike(_FILE_NAME))).alias("is_file"))


def _directory(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", F.lit(""))).otherwise(F.lit(""))


def licences(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = 0.75) -> DataFrame:
    """`doc_id, path, licence, origin, score, licence_dir` per row of `doc_id, path, text`.

    `origin` is `own`, `inherited` or null; `licence_dir` is the directory that an inherited licence comes
    from. A directory with several licence files has that of the highest score, then the first name.
    Null texts are empty; a null path lies in the root; repeated rows are judged alike; an empty table
    gives an empty table.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    judged = materialise(own_licences(rows, templates, threshold).withColumn("directory", _directory(F.col("path"))))
    files = judged.where("is_file").groupBy("directory").agg(F.min(F.struct((-F.col("score")).alias("minus"), "licence")).alias("best"))
    files = files.select(F.col("directory").alias("licence_dir"), F.col("best.licence").alias("inherited"))
    parts = F.split("directory", "/", -1)
    above = judged.select("directory").distinct().select(
        "directory", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("licence_dir")
    ).distinct()
    nearest = above.join(files, "licence_dir").groupBy("directory").agg(F.max(F.struct(F.length("licence_dir").alias("depth"), "licence_dir", "inherited")).alias("near"))
    named = judged.join(materialise(nearest), "directory", "left")
    own = F.col("licence").isNotNull()
    return named.select(
        "doc_id", "path", F.coalesce("licence", "near.inherited").alias("licence"),
        F.when(own, F.lit("own")).when(F.col("near").isNotNull(), F.lit("inherited")).alias("origin"), "score",
        F.when(~own, F.col("near.licence_dir")).alias("licence_dir"),
    )
