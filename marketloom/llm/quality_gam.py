"""Quality classifier: a generalised additive model with pairwise interactions.

Every text becomes a few counts and ratios. Shallow trees, boosted in turn over one feature after
the other, add up to a lookup table per feature; the pairs of features that explain most of what is
left get tables of two dimensions in the same way. A score is a sum of table entries.

Features of all documents are computed once and written; labels join these few numbers, not texts.
The model is fitted on at most `max_rows` labelled rows, taken by the hash of their id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_share, materialise, texts
from .words import blocks

FEATURES = (
    "log_chars", "log_words", "word_length", "symbols", "upper", "digits", "marks", "other", "bars", "doubled_marks", "distinct_words",
    "stuttered", "distinct_lines", "line_words", "closed_lines", "short_words", "capitals",
)
_SYMBOL, _UPPER, _DIGIT, _MARK, _LOWER, _SPACE, _REST, _BAR = range(8)
_CLASS = np.full(256, _REST, np.uint8)
for _chars, _kind in (("#*$%&<>@^~_=+\\/{}[]", _SYMBOL), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), ("0123456789", _DIGIT), (".,;:!?'\"()-", _MARK), ("abcdefghijklmnopqrstuvwxyz", _LOWER), (" \t\n\r\x0b\x0c", _SPACE), ("|", _BAR)):
    _CLASS[np.frombuffer(_chars.encode(), np.uint8)] = _kind


def features(text: str) -> list[float]:
    """The features of one whole text; an empty text has zeros."""
    counts, distinct, lines, seen = np.zeros(8, np.int64), set(), 0, set()
    words = stuttered = closed = short = doubled = capitals = 0
    last = None
    for block in blocks(text):
        counts += np.bincount(_CLASS[np.frombuffer(block.encode("utf-8", "replace"), np.uint8)], minlength=8)
        part = block.split()
        words += len(part)
        distinct.update(map(hash, part) if len(text) > len(block) else part)
        stuttered += sum(map(eq, part, part[1:])) + bool(part and part[0] == last)
        last = part[-1] if part else last
        short += sum(map((3).__ge__, map(len, part)))
        capitals += sum(map(str.isupper, part))
        doubled += block.count("!!") + block.count("??")
        for line in filter(None, map(str.strip, block.split("\n"))):
            lines += 1
            seen.add(hash(line))
            closed += line[-1] in ".!?:\"')"
    chars, n, m = max(1, int(counts.sum())), max(1, words), max(1, lines)
    shown = max(1, chars - int(counts[_SPACE]))
    return [
        np.log1p(chars if text else 0), np.log1p(words), shown / n if words else 0.0, counts[_SYMBOL] / shown, counts[_UPPER] / shown, counts[_DIGIT] / shown,
        counts[_MARK] / shown, counts[_REST] / shown, counts[_BAR] / n, doubled / n, len(distinct) / n, stuttered / n, len(seen) / m, np.log1p(words / m),
        closed / m, short / n, capitals / n,
    ]


def with_features(docs: DataFrame) -> DataFrame:
    """`doc_id` and `x`, the features of its text; one row for every row of the documents."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return texts(docs).mapInArrow(compute, "doc_id long, x array<double>")


@dataclass
class Model:
    """Cut points per feature, a table per feature, and tables of pairs; `base` alone if nothing could be learnt."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        bins = self.bins(x) if len(x) and self.cuts else []
        for table, b in zip(self.tables, bins, strict=False):
            total += table[b]
        for i, j, table in self.pairs:
            total += table[_coarse(bins[i], self.cuts[i]), _coarse(bins[j], self.cuts[j])]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


_COARSE = 8


def _coarse(bins: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return bins * _COARSE // (len(cuts) + 1)


def _tree(gradient: np.ndarray, hessian: np.ndarray, leaves: int = 3, least: float = 2.0, damping: float = 1.0) -> np.ndarray:
    """Newton steps of a tree with a few leaves over ordered bins."""
    edges = [0, len(gradient)]
    g, h = np.concatenate(([0], np.cumsum(gradient))), np.concatenate(([0], np.cumsum(hessian)))
    for _ in range(leaves - 1):
        best, at = 1e-9, None
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a < 2:
                continue
            mid = np.arange(a + 1, b)
            gl, hl, gr, hr = g[mid] - g[a], h[mid] - h[a], g[b] - g[mid], h[b] - h[mid]
            gain = gl**2 / (hl + damping) + gr**2 / (hr + damping) - (g[b] - g[a]) ** 2 / (h[b] - h[a] + damping)
            gain[(hl < least / 4) | (hr < least / 4)] = 0
            if gain.max() > best:
                best, at = gain.max(), int(mid[gain.argmax()])
        if at is None:
            break
        edges = sorted([*edges, at])
    out = np.zeros(len(gradient))
    for a, b in zip(edges, edges[1:], strict=False):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + damping)
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 200, rate: float = 0.1, bins: int = 32, n_pairs: int = 6) -> Model:
    """Boost the tables on labelled rows. Without rows, or with one label only, the score is the share of label 1 (0.5 without rows)."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    if not 0 < y.sum() < len(y):
        return Model(base, [], [], [])
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    model = Model(base, cuts, [np.zeros(len(c) + 1) for c in cuts], [])
    b = model.bins(x)
    total = np.full(len(y), base)
    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            p = 1 / (1 + np.exp(-total))
            step = rate * _tree(np.bincount(b[j], y - p, len(table)), np.bincount(b[j], p * (1 - p), len(table)))
            table += step
            total += step[b[j]]
    coarse = [_coarse(v, c) for v, c in zip(b, cuts, strict=True)]
    p = 1 / (1 + np.exp(-total))

    def cells(i: int, j: int) -> np.ndarray:
        return coarse[i] * _COARSE + coarse[j]

    def gain(i: int, j: int) -> float:
        c = cells(i, j)
        g, h = np.bincount(c, y - p, _COARSE**2), np.bincount(c, p * (1 - p), _COARSE**2)
        return float((g**2 / (h + 1)).sum())

    pairs = sorted(((gain(i, j), i, j) for j in range(len(cuts)) for i in range(j)), reverse=True)[:n_pairs]
    model.pairs = [(i, j, np.zeros((_COARSE, _COARSE))) for _, i, j in pairs]
    for _ in range(rounds // 4):
        for i, j, table in model.pairs:
            p, c = 1 / (1 + np.exp(-total)), cells(i, j)
            g, h = np.bincount(c, y - p, _COARSE**2).reshape(_COARSE, _COARSE), np.bincount(c, p * (1 - p), _COARSE**2).reshape(_COARSE, _COARSE)
            # A tree of two levels: leaves by the one feature, each split by the other.
            first = _tree(g.sum(1), h.sum(1))
            step = np.zeros_like(table)
            for value in np.unique(first):
                rows = first == value
                step[rows] = rate * _tree(g[rows].sum(0), h[rows].sum(0))
            table += step
            total += step.ravel()[c]
    return model


def train(rows: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Model:
    """Fit on labelled rows that aren't held out: at most `max_rows`, those whose hashed id comes first.

    Labels other than 0 and 1 and null ids are left out. A document with several labels counts with each.
    """
    known = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    sample = (
        rows.where(~F.col("held_out")).join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "x").limit(max_rows)
        .select("x", "quality").collect()
    )
    return fit(np.array([r["x"] for r in sample], float).reshape(-1, len(FEATURES)), np.array([r["quality"] for r in sample], float))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 20_000) -> DataFrame:
    """`doc_id, held_out, score, predicted` for every row of the documents.

    Null and empty texts are scored by their zeros; repeated rows are scored alike; a null id is held
    out by the checksum of empty text.
    """
    rows = materialise(with_features(docs).select("doc_id", "x", (id_share(5) == 0).alias("held_out")))
    sent = docs.sparkSession.sparkContext.broadcast(train(rows, labels, max_rows))

    def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.array(frame.pop("x").tolist(), float).reshape(-1, len(FEATURES))
            score = sent.value.score(x)
            yield frame.assign(score=score, predicted=(score >= threshold).astype(np.int32))

    return rows.mapInPandas(predict, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 20_000) -> DataFrame:
    """The rows of the documents, with all their columns, that score `threshold` or more; texts are not shuffled."""
    rows = materialise(with_features(docs).select("doc_id", "x", (id_share(5) == 0).alias("held_out")))
    sent = docs.sparkSession.sparkContext.broadcast(train(rows, labels, max_rows))
    column = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py() or "") for t in batch.column(column)], float).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(sent.value.score(x) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
