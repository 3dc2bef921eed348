"""Full-text indexes, repeated passages and the audit of filters against plain restatements."""

import hashlib
import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import audit, fm_index, substrings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside, as columns of the documents.
CLASHING = ("same", "copy_a", "copy_b", "gram", "grams", "runs", "start", "words", "bucket", "place", "part", "fails", "copy", "first", "last", "good", "n", "size", "whole")


def frame(spark, texts, clash=True):
    df = spark.createDataFrame([(k, t, *(rest or ["en"]), "s", None) for k, t, *rest in texts], SCHEMA)
    return df.withColumns({c: F.lit("other") for c in CLASHING}) if clash else df


def suffix(text, p):
    out = []
    while text[p]:
        out.append(int(text[p]) + 10**6)
        p += 1
    return [*out, p]


@pytest.mark.parametrize("seed", range(40))
def test_index_finds_all_repeats(seed):
    rng = random.Random(seed)
    letters, width = rng.choice([1, 2, 3, 10, 200]), rng.choice([1, 2, 3, 5])
    sequences = [[rng.randrange(1, letters + 1) for _ in range(rng.randrange(30))] for _ in range(rng.randrange(1, 15))]
    sequences[0] = sequences[-1] + sequences[0]
    weights = [rng.choice([1, 1, 1, 2]) for _ in sequences]
    text = np.array([x for s in sequences for x in [*s, 0]], np.int64)
    lengths = np.array([len(s) for s in sequences])
    begins = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
    order = fm_index.suffix_order(text).tolist()
    assert order == sorted(range(len(text)), key=lambda p: suffix(text, p))
    counts = Counter()
    windows = [(k, i, tuple(s[i : i + width])) for k, s in enumerate(sequences) for i in range(len(s) - width + 1)]
    for k, _, w in windows:
        counts[w] += weights[k]
    lane, first, end = fm_index.repeated_windows(text, begins, lengths, np.repeat(weights, lengths + 1), width)
    got = [(int(k), i) for k, a, b in zip(lane, first, end) for i in range(a, b)]
    assert len(got) == len(set(got)) and set(got) == {(k, i) for k, i, w in windows if counts[w] > 1}


def test_wavelet_matrix_counts():
    rng = np.random.default_rng(0)
    symbols = rng.integers(0, 37, 1000)
    matrix = fm_index.WaveletMatrix(symbols, 37)
    asked, places = rng.integers(0, 37, 300), rng.integers(0, 1001, 300)
    got = matrix.descend(asked, places) - matrix.descend(asked, np.zeros(300, np.int64))
    assert got.tolist() == [int((symbols[:p] == c).sum()) for c, p in zip(asked, places)]


def plain(texts, width):
    """What every row keeps, by counting all windows."""
    words = [(t or "").encode().split() for t in texts]
    counts = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = {i + k for i in range(len(w) - width + 1) if counts[tuple(w[i : i + width])] > 1 for k in range(width)}
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(rng.choice([2, 40, 3000]))] + ["é\x85x", "日本 語"]
    fresh = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, family = fresh(60), fresh(120)
    texts = []
    for i in range(60):
        words = fresh(rng.randrange(90))
        if i % 3 == 0:  # a passage in different surroundings
            words = fresh(rng.randrange(40)) + passage[rng.randrange(20) :] + words
        if i % 5 == 0:  # near copies
            words = list(family)
            words[rng.randrange(120)] = f"only{i}"
        texts.append(rng.choice([" ", "\n", " \t"]).join(words))
    return [*texts, texts[1], texts[3], "x " * 200, "a b c " * 30, None, "", " ", "one"]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("crowded", [3, 512])
def test_repeated_passages(spark, seed, crowded):
    texts = corpus(seed)
    ids = [None if i == 4 else i // 2 if i < 20 else i for i in range(len(texts))]
    docs = frame(spark, zip(ids, texts))
    got = substrings.deduplicated(docs, crowded=crowded, shard_words=500).collect()
    want = Counter((i, *x) for i, x in zip(ids, plain(texts, 35)))
    assert Counter(tuple(r) for r in got) == want
    spans = Counter()
    for r in substrings.passages(docs, crowded=crowded).collect():
        spans[r.doc_id] += r.end - r.start
    assert +spans == +Counter({k: sum(n for i, _, n, _ in want.elements() if i == k) for k in set(ids)})


def test_repeated_passages_of_rows_that_come_twice_and_of_an_empty_table(spark):
    long = " ".join(f"w{i}" for i in range(40))
    got = substrings.deduplicated(frame(spark, [(1, long), (1, long), (2, "a b")])).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(map(tuple, got)) == [(1, 40, 40, empty), (1, 40, 40, empty), (2, 2, 0, hashlib.sha256(b"a b").hexdigest())]
    assert substrings.deduplicated(frame(spark, [])).isEmpty() and substrings.passages(frame(spark, [])).isEmpty()


def test_repeats_in_a_small_window(spark):
    texts = ["a b c d e", "x a b c y", "c d e f", "q q q q"]
    got = {r.doc_id: r.n_removed for r in substrings.deduplicated(frame(spark, enumerate(texts)), width=3, gram=2).collect()}
    assert got == {i: n for i, (_, n, _) in enumerate(plain(texts, 3))}


def test_potentials_give_mean_removals():
    rng = random.Random(1)
    counts = [rng.randrange(50) for _ in range(32)]
    gone = audit.removals(counts)
    potential = audit.potentials(gone)
    for i in range(5):
        total = 0
        for order in permutations(range(5)):
            before = sum(1 << j for j in order[: order.index(i)])
            total += gone[before | 1 << i] - gone[before]
        assert potential[31] - potential[31 & ~(1 << i)] == total


def fails_of(rows):
    out = []
    for key, text, _ in rows:
        words = (text or "").encode().split()
        found = [
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text or "") > 3 * len(text or ""),
            any(c in "#$%&*|" for c in text or ""), key is not None and any((t or "") == (text or "") and k is not None and k < key for k, t, _ in rows),
        ]
        out.append({"ABCDE"[i] for i, x in enumerate(found) if x})
    return out


def test_audit(spark):
    rng = random.Random(2)
    rows = []
    for i in range(80):
        words = [rng.choice(["a", "B", "c#", "dog", f"w{rng.randrange(900)}", f"v{rng.randrange(900)}"][rng.randrange(4) :]) for _ in range(rng.choice([0, 3, 190, 260, 400]))]
        rows.append((None if i % 31 == 0 else i // 2 if i < 10 else i, " ".join(words), rng.choice(["en", "de", None])))
    rows += [(200 + i, rows[20 + i // 3][1], "en") for i in range(9)] + [(300, None, "fr"), (301, "", "fr"), (301, "", "fr")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(0, 80, 3), 5, 5, 201]] + [(None, 1, 1)]
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("fails", F.lit("x"))
    got = {(r.part, r.filter_order, r.step): r for r in audit.audit(frame(spark, rows), marks).collect()}
    fails = fails_of(rows)
    parts = {lang or "" for _, _, lang in rows}
    assert len(got) == len(parts) * 600
    for part in parts:
        mine = [(k, f) for (k, _, lang), f in zip(rows, fails) if (lang or "") == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, x in enumerate(order, 1):
                out = [k for k, f in left if x in f]
                r = got[part, "".join(order), step]
                assert r.removed == len(out) and r.kept == len(left) - len(out)
                assert r.redundant == sum(x in f for _, f in mine) - len(out) and r.unique_fails == sum(f == {x} for _, f in mine)
                assert r.good_lost == sum(k in good for k in out) and r.toxic_lost == sum(k in toxic for k in out)
                left = [(k, f) for k, f in left if x not in f]
                shapley[x] += len(out)
        assert all(got[part, "".join(o), s].shapley == shapley[x] for o in permutations("ABCDE") for s, x in enumerate(o, 1))


def test_audit_of_an_empty_table(spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert audit.audit(frame(spark, []), labels).isEmpty()
    assert audit.audit(frame(spark, [(1, "a", "en")]), labels.limit(0)).count() == 600
