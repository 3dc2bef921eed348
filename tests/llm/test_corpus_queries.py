"""Registered corpus queries on the smallest tables, against SQL or against plain Python."""

import collections
import hashlib
import math
import os
import re
import sys
import zlib

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

from check import compare, connect  # noqa: E402

import corpus_pipeline  # noqa: E402
from marketloom.llm import queries  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
#: A few hundred labels, enough to learn from.
LARGER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def run(spark, name):
    return queries.QUERIES[name](spark, FOLDER).collect()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, FOLDER), connect(FOLDER), queries.SQL[name]) is None


def packed_rightly(rows, texts):
    """Every piece is the tokenizer's, and sequences are gapless and within 4096 tokens."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.VOCABULARY)
    got = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows}
    want = {}
    for key, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[key, piece] = (at, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)))
    assert got == want
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096
    return len(sequences), sum(r["length"] for r in rows)


def test_packing(spark, docs):
    n, tokens = packed_rightly(run(spark, "op1_packing"), {k: r["text"] for k, r in docs.items()})
    assert n <= math.ceil(tokens / 4096) * 1.05 + 1


SECRETS = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18), ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def only_digits(m):
    return re.sub("[^0-9]", "", m[0])


PERSONAL = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 14 <= len(only_digits(m)) <= 19 and luhn(only_digits(m))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 10 <= len(only_digits(m)) <= 15),
)


def plain_spans(text, kinds):
    found = [(m.start(), rank, kind, m.end()) for rank, (kind, pattern, valid) in enumerate(kinds) for m in pattern.finditer(text or "") if valid(m)]
    return [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found)]


def spans_agree(rows, texts, kinds):
    assert len(rows) == len(texts)
    names = [k for k, _, _ in kinds]
    for r in rows:
        want = plain_spans(texts[r["doc_id"]], kinds)
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (r, want)
        assert [s for s in r["spans"].split(",") if s.split(":")[0] in names] == want
        assert [r[f"n_{k}"] for k in names] == [sum(s.startswith(k + ":") for s in want) for k in names]


@pytest.mark.parametrize(("name", "kinds"), [("op4_secrets", SECRETS), ("op5_personal_data", PERSONAL)])
def test_spans(spark, docs, name, kinds):
    spans_agree(run(spark, name), {k: r["text"] for k, r in docs.items()}, kinds)


def test_quality_is_learnt(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    rows = queries.op6_quality_gam(spark, LARGER).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows)
    judged = [r["predicted"] == labels[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(judged) >= 0.97 * len(judged) > 0


def test_language_is_learnt(spark, docs):
    rows = run(spark, "op9_language_id")
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    judged = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in rows if r["held_out"]]
    assert sum(judged) >= 0.97 * len(judged) > 0


def longest_common(a, b):
    """Length of the longest common part of two word lists, by the plain table."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def close_pairs(texts, similarity=0.8):
    """Pairs of different texts whose words in both and in the same order, over those in either, reach the similarity."""
    words = {k: (t or "").lower().split() for k, t in texts.items()}
    bags = {k: collections.Counter(w) for k, w in words.items()}
    keys = sorted(k for k in words if words[k])
    for i, a in enumerate(keys):
        for b in keys[:i]:
            n = len(words[a]) + len(words[b])
            least = similarity / (1 + similarity) * n - 1e-9
            if words[a] != words[b] and min(len(words[a]), len(words[b])) >= least and sum((bags[a] & bags[b]).values()) >= least and longest_common(words[a], words[b]) >= least:
                yield b, a


def brute_classes(texts):
    """Smallest id of the class of every document, comparing all pairs."""
    to, seen = {k: k for k in texts}, {}

    def find(x):
        while to[x] != x:
            x = to[x]
        return x

    copies = [(seen.setdefault(tuple((texts[k] or "").lower().split()), k), k) for k in sorted(texts)]
    for b, a in [*copies, *close_pairs(texts)]:
        x, y = find(a), find(b)
        to[max(x, y)] = min(x, y)
    return {k: find(k) for k in texts}


def test_near_duplicates(spark, docs):
    got = {r["doc_id"]: r["class_id"] for r in run(spark, "op7_order_minhash")}
    assert got == brute_classes({k: r["text"] for k, r in docs.items()})


def test_edited_copies_are_found(spark):
    """Of all pairs of ten words or more that agree in 90 % of their words, nearly all are in one class."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect() if 10 <= len((r["text"] or "").split()) <= 1500}
    found = {r["doc_id"]: r["class_id"] for r in queries.op7_order_minhash(spark, LARGER).collect()}
    pairs = list(close_pairs(texts, 0.9 / 1.1))
    together = sum(found[a] == found[b] for a, b in pairs)
    assert len(pairs) > 50 and together >= 0.95 * len(pairs), (together, len(pairs))


def brute_leaks(texts, items):
    """Pairs of which the document holds the whole item, words compared without case and outer punctuation."""
    bare = lambda t: " " + " ".join(w for w in (re.sub(r"^\W+|\W+$", "", w.lower()) for w in (t or "").split()) if w) + " "
    return {(d, i) for d, t in texts.items() for i, item in items.items() if bare(item) in bare(t)}


def test_decontamination(spark, docs):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in run(spark, "op3_decontamination")}
    want = brute_leaks({k: r["text"] for k, r in docs.items()}, items)
    assert want and got == want


def test_licences(spark, docs):
    known = {"Apache-2.0": "Apache License, Version 2.0", "MIT": "the MIT License", "GPL-3.0": "GNU General Public License, version 3", "CC-BY-NC-4.0": "CC BY-NC 4.0"}
    got = {r["doc_id"]: r["licence"] for r in run(spark, "op10_licences") if r["origin"] == "own"}
    want = {k: {n for n, notice in known.items() if notice.lower() in r["text"].lower()} for k, r in docs.items() if r["text"]}
    want = {k: v for k, v in want.items() if v}
    assert got.keys() == want.keys() and all(got[k] in want[k] for k in got)


def test_pipeline_stages_take_effect(spark, docs, tmp_path):
    """Each stage against the plain statement of what it does to its own input."""
    from pyspark.sql import functions as F

    now = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in now.collect()}
        stage(spark, now, FOLDER).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            packed_rightly(now.collect(), before)
            break
        assert now.columns == columns
        after = {r["doc_id"]: r["text"] for r in now.collect()}
        assert len(after) == now.count()
        if name == "quality":
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
            wrong = [k for k in before if k in labels and (k in after) != labels[k]]
            assert len(wrong) <= 0.05 * len(labels)
        elif name == "lines":
            assert after == brute_lines(before)
            assert now.where(F.length("text") != F.col("n_chars")).isEmpty()
        elif name == "near_duplicates":
            assert set(after) == set(brute_classes(before).values())
        elif name == "decontamination":
            items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
            assert set(before) - set(after) == {d for d, _ in brute_leaks(before, items)}
    assert corpus_pipeline.run(spark, FOLDER).count() == now.count()


def brute_lines(texts):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = collections.defaultdict(set)
    for k, text in texts.items():
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(k)
    gone = {x: max(ks) for x, ks in holders.items() if len(ks) >= 3}
    return {k: "\n".join(x for x in (t or "").split("\n") if gone.get(key(x), k) == k) for k, t in texts.items()}
