"""Corpus operators on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import credentials, decontaminate, langid, licences, line_dedup, line_rules, order_minhash, packing, personal, quality_gam, queries
from marketloom.llm.common import shared_folder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside, as columns of the documents.
CLASHING = ("row", "kept", "gone", "keys", "lines", "words", "_id", "_same", "rep", "n", "bucket", "root", "start", "kind", "x", "best", "_bad", "_kept", "window", "same", "rank", "salt")


def frame(spark, texts, clash=True):
    df = spark.createDataFrame([(k, t, "en", "s", None) for k, t in texts], SCHEMA)
    return df.withColumns({c: F.lit("other") for c in CLASHING}) if clash else df


LINE = "a line that stands in many documents"
ODD = [(1, None), (2, ""), (3, LINE), (4, f"{LINE}\nb"), (5, f"\t{LINE.upper()} \nc"), (5, f"\t{LINE.upper()} \nc"), (None, "no id, but a text of its own"), (6, "word " * 60_000), (7, "\n\n\n")]


def line_result(spark, docs):
    return line_dedup.dedup(docs, shared_folder(spark, "t")).select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", "kept").collect()


def test_line_dedup(spark):
    got = {(r.doc_id, r.n_lines, r.n_dropped, r.kept if r.doc_id != 6 else "") for r in line_result(spark, frame(spark, ODD))}
    # The largest document that holds the line keeps it.
    assert got == {
        (1, 1, 0, ""), (2, 1, 0, ""), (3, 1, 1, ""), (4, 2, 1, "b"), (5, 2, 0, f"\t{LINE.upper()} \nc"), (None, 1, 0, "no id, but a text of its own"), (6, 1, 0, ""), (7, 4, 0, "\n\n\n"),
    }
    out = line_dedup.cleaned(frame(spark, ODD), shared_folder(spark, "t"))
    assert out.columns == frame(spark, ODD).columns and out.count() == len(ODD) and out.where("kept <> 'other'").isEmpty()
    assert line_result(spark, frame(spark, [])) == []


def test_line_keys_beyond_ascii(spark):
    lines = ["Straße mit Größe und Äpfeln", "STRAßE mit Größe und Äpfeln", "straße mit größe und äpfeln", "strasse mit grÖße und äpfeln", "twenty letters Kelvin", "twenty letters kelvin", "twenty letters İx dot", "twenty letters i̇x dot"]
    texts = [(i, x) for i, x in enumerate(lines * 3)]
    lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    last = {lower(x): i for i, x in texts}
    got = {r.doc_id: r.n_dropped for r in line_result(spark, frame(spark, texts))}
    assert got == {i: int(i != last[lower(x)]) for i, x in texts}


def test_lines_of_repeated_rows_count_once(spark):
    other = "one more line that some documents hold"
    texts = [(1, LINE), (2, LINE), (2, LINE), (2, f"{LINE}\nb"), (3, f"{other}\n{other}"), (4, other), (4, f"a\n{other}"), (5, other), (None, LINE[::-1]), (None, f"x\n{LINE[::-1]}"), (None, LINE[::-1])]
    got = sorted((r.doc_id or 0, r.n_lines, r.n_dropped) for r in line_result(spark, frame(spark, texts)))
    # The first line is in two documents only, whatever the rows.
    assert got == [(0, 1, 0), (0, 1, 0), (0, 2, 0), (1, 1, 0), (2, 1, 0), (2, 1, 0), (2, 2, 0), (3, 2, 2), (4, 1, 1), (4, 2, 1), (5, 1, 0)]


def test_line_runs_go_on_with_new_batches(spark):
    runs = line_dedup.LineRuns(spark, shared_folder(spark, "t"), fanout=2)
    batches = [[(1, LINE)], [(2, LINE + "\n" + LINE), (3, "another line that is long enough")], [(4, LINE)], [(5, "no such line so far, I think")]]
    for batch in batches:
        run = line_dedup.batch_run(line_dedup.line_keys(frame(spark, batch))).drop("batch")
        fresh = runs.new_keys(run).count()
        runs.add(run)
        assert fresh == {1: 1, 2: 1, 4: 0, 5: 1}[batch[0][0]]
    assert sorted((r.docs, r.largest) for r in runs.totals().collect()) == [(1, 3), (1, 5), (3, 4)]
    assert [len(level) for level in runs.levels] == [0, 0, 1]


def test_packing(spark):
    rows = packing.pack(packing.token_pieces(frame(spark, ODD), queries.VOCABULARY)).collect()
    assert {(r.doc_id, r.length) for r in rows if r.doc_id in (1, 2)} == {(1, 1), (2, 1)}
    assert sum(r.doc_id == 5 for r in rows) == 2 and [r.length for r in sorted((r for r in rows if r.doc_id == 6), key=lambda r: r.piece)][:-1] == [4096] * 14
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(o == sum(n for _, n in sorted(v)[:i]) for v in by.values() for i, (o, _) in enumerate(sorted(v)))
    assert packing.pack(packing.token_pieces(frame(spark, []), queries.VOCABULARY)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 257): rng.randrange(1, 400) for _ in range(rng.choice((1, 5, 120)))}
    p = packing.plan(counts, 256)
    filled: dict = {}
    for length, n in counts.items():
        for rank in range(n):
            at = np.searchsorted(p["key"], (length << 44) + rank, side="right") - 1
            i = rank - p["rank"][at]
            filled.setdefault(int(p["sequence"][at] + i // p["per"][at]), []).append((int(p["offset"][at] + i % p["per"][at] * length), length))
    for places in filled.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 256
    total = sum(k * v for k, v in counts.items())
    assert len(filled) <= 1.25 * total / 256 + 0.6 * sum(v for k, v in counts.items() if k > 128) + 2


def test_tokens_beyond_plain_characters(spark):
    from tokenizers import Tokenizer

    whole, ours = Tokenizer.from_file(queries.VOCABULARY), packing.TokenBytes(queries.VOCABULARY)
    for text in ("It's 12 o'clock, we'll see!!", "ÀÉÎ straße Žluť'S", "ΑΣ Σίσυφος", "<|endoftext|> a", "日本 ́e x²", "a b\x1cc d", "İstanbul ŉ", "", " \n"):
        assert ours(text) == np.asarray(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_decontamination(spark):
    item = "Tom buys 12 apples and 3 pears for 4 dollars and then walks 12 km to the old market with Anna before noon"
    docs = [
        (1, "Intro. " + item.replace("12", "70").replace("3 pears", "5 pears").replace("Anna", "Eve")), (2, item.replace("12 apples", "70 apples")), (3, None), (4, ""),
        (5, f"x y. {item}. z"), (5, f"x y. {item}. z"), (6, "Tom buys apples"), (None, item), (7, "the " * 40_000), (8, f"{item}\n{item}"),
    ]
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "too short"), (1, item)], "item_id long, text string").withColumn("at", F.lit(1))
    got = {(r.doc_id, r.item_id, r.verbatim) for r in decontaminate.contaminated(frame(spark, docs), bench).collect()}
    # Document 2 has two values for the item's 12, so that it is another question.
    assert got == {(1, 1, False), (5, 1, True), (None, 1, True), (8, 1, True)}
    assert {r.doc_id for r in decontaminate.without_contaminated(frame(spark, docs), bench).collect()} == {2, 3, 4, 6, 7}
    assert decontaminate.contaminated(frame(spark, []), bench).count() == decontaminate.contaminated(frame(spark, docs), bench.limit(0)).count() == 0


def invented(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n)]


def held(spark, docs, items):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(spark, docs), bench).collect()}


def test_passages_of_long_items(spark):
    item = invented(200)
    docs = [(1, "before " + " ".join(item[50:110]) + " after"), (2, " ".join(item[:20])), (3, " ".join(item[:19])), (4, " ".join(item[i] for i in range(200) if i % 20))]
    assert held(spark, docs, [" ".join(item)]) == {(1, 0), (2, 0), (4, 0)}


def test_one_conflict_does_not_hide_a_copy(spark):
    item = invented(60)
    item[10] = item[30] = item[50] = "Anna"
    other = [*item[:50], "Eve", *item[51:]]
    both = [*item[:10], "Eve", *item[11:30], "Mia", *item[31:]]
    assert held(spark, [(1, " ".join(other)), (2, " ".join(both))], [" ".join(item)]) == {(1, 0), (2, 0)}


def test_items_without_literals(spark):
    sums, names = "Compute 12 + 7 * 3 - 4 / 2", "Name the capitals of France, Spain, Italy, Germany, Poland, Sweden and Norway"
    han, kana, tiny = "一个农夫有十七只羊，除了九只以外都死了。还剩几只？", "東京から大阪までの距離は何キロですか", "什么是光"
    items = [sums, names, han, kana, tiny]
    docs = [(i, f"so: {x} and on") for i, x in enumerate(items)] + [
        (10, f"他问：{han}我不知道。"), (11, "Compute 13 + 7 * 3 - 4 / 2"), (12, "We visit France, Spain, Italy and Greece."), (13, f"前文{kana[:6]}別の話です。"), (14, f"<p>{kana}</p>"), (15, f"a {sums.upper()}"),
    ]
    assert held(spark, docs, items) == {(0, 0), (1, 1), (2, 2), (3, 3), (10, 2), (14, 3), (15, 0)}


def spans(rows, column):
    return {r.doc_id: [(s.kind, s.start, s.end) for s in sorted(r[column])] for r in rows}


def test_secrets_are_linked(spark):
    token = "Zk3vQ9xT7mB2nL5pR8wY1cD4"
    docs = [
        (1, None), (2, ""), (3, f"é user: ann.lee then {token} end"), (4, f"{token} alone"), (5, "user: ann.lee alone"), (6, f"user: ann.lee {'x ' * 300}{token}"),
        (7, f"at https://db.example.org/x {token}"), (8, 'password="short" token = "abcdefghijkl"'), (8, 'password="short" token = "abcdefghijkl"'),
        (9, "AKIAABCDEFGHIJKLMN AKIASHORT 0123456789abcdef0 0123"), (None, f"{token} login=bob"), (10, "deadbeef " * 20_000 + "0123456789abcdef"),
    ]
    rows = credentials.secrets(frame(spark, docs)).collect()
    assert len(rows) == 11
    base, linked = spans(rows, "base"), spans(rows, "linked")
    assert base[8] == [("assign", 17, 38)] and base[9] == [("access", 0, 18), ("hex", 29, 46)] and base[10] == [("hex", 180_000, 180_016)]
    assert {k: [s[0] for s in v] for k, v in linked.items() if v} == {3: ["login", "random"], 7: ["endpoint", "random"], None: ["random", "login"]}
    assert linked[3][0][1:] == (2, 15)
    assert credentials.digest(credentials.secrets(frame(spark, []))).count() == 0


def test_overlapping_parts_hide_none(spark):
    inside = "https://host.example/" + "0123456789" * 4
    docs = [(1, f"{inside}, next: password = longsecretvalue"), (2, "https://a.example.org see https://h.org/user:ann.lee"), (3, f"{inside} alone"), (4, f"user: ann.lee {inside} 0123456789abcdef")]
    linked = spans(credentials.secrets(frame(spark, docs)).collect(), "linked")
    assert linked[1] == [("endpoint", 0, 61)] and linked[2] == linked[3] == [] and [s[0] for s in linked[4]] == ["login", "endpoint"]


def test_weak_parts_need_a_secret_in_their_scope(spark):
    token = "Zk3vQ9xT7mB2nL5pR8wY1cD4"
    long = "Zk" * 60 + "7" + "x" * 79
    docs = [
        (1, "user: anna. See https://example.com/about"), (2, f"user: ann.lee\n\n{token}"), (3, f"user: ann.lee\n \t\n{token}"), (4, f"user: ann.lee\n{token}"),
        (5, f"[a]\nuser: ann.lee\n[b]\n{token}"), (6, f'{{"user": "ann.lee"}}, {{"x": "{token}"}}'), (7, f'{{"user": "ann.lee", "more": {{"x": "{token}"}}}}'), (8, f"user: ann.lee\n---\n{token}"),
        (9, f"client_id: app.one {long}"), (10, "client_id: app.one " + "zk" * 100), (11, f"user: a.b\n\nuser: c.d {token}\n\nhttps://example.com/about"),
    ]
    linked = spans(credentials.secrets(frame(spark, docs)).collect(), "linked")
    both = ["login", "random"]
    assert {k: [s[0] for s in v] for k, v in linked.items() if v} == {4: both, 7: both, 9: both, 11: both}
    assert linked[9][1] == ("random", 19, 219) and linked[11][0][1] == 11


def test_personal_data(spark):
    docs = [(1, None), (2, ""), (3, "é a@b.c_d@e.ff, 1.2.3.4.5.6.7.256"), (4, "4111 1111 1111 1111 and +1 (136) 555-7479."), (None, "x@y.zz"), (5, "9" * 50_000), (5, "9" * 50_000), (6, "a" * 200_000)]
    docs += [(100 + i, f"Please call me, phone ({200 + i}) 555-{1000 + i}.") for i in range(30)] + [(200 + i, f"see version 1{i:02d}.555.{2000 + i}x build={300 + i}.555.{1000 + i}") for i in range(30)]
    rows = personal.personal_data(frame(spark, docs)).collect()
    assert len(rows) == len(docs) - 1
    base, added = spans(rows, "base"), spans(rows, "added")
    assert base[3] == [("email", 2, 7), ("email", 7, 14), ("ip", 16, 23)] and base[4] == [("card", 0, 19), ("phone", 24, 41)] and base[None] == [("email", 0, 6)]
    assert base[5] == base[6] == base[1] == base[2] == []
    assert sum([s[0] for s in added[100 + i]] == ["local"] for i in range(30)) == 30 and not any(added[200 + i] for i in range(30))
    assert personal.digest(personal.personal_data(frame(spark, []))).count() == 0
    assert personal.digest(personal.personal_data(frame(spark, [(1, "nothing here")]))).first().spans == ""


def test_quality(spark):
    good = [(i, f"The quick fox number {i} walks home. It sleeps there well.\nNext day it eats {i} plums.") for i in range(120)]
    bad = [(1000 + i, "### $$$ | %%% | &&& " * (3 + i % 5)) for i in range(120)]
    docs = frame(spark, [*good, *bad, (None, None), (2000, ""), (2001, "word " * 60_000), (5, good[5][1])])
    labels = spark.createDataFrame([(k, 1) for k, _ in good] + [(k, 0) for k, _ in bad] + [(1, None), (2, 7), (None, 1)], "doc_id long, quality int").withColumn("x", F.lit(1))
    got = quality_gam.scored(docs, labels).collect()
    assert len(got) == 244 and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    assert all(r.predicted == (r.doc_id < 1000) for r in got if r.doc_id is not None and r.doc_id < 2000)
    kept = quality_gam.accepted(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {k for k, _ in good}
    assert {r.score for r in quality_gam.scored(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_gam.scored(frame(spark, []), labels).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    edited = [*words[:150], "other", *words[151:]]
    near = [w if rng.random() < 0.9 else "z" + w for w in words]
    far = [w if rng.random() < 0.8 else "z" + w for w in words]
    moved = words[150:] + words[:150]
    docs = [(5, " ".join(words)), (3, " ".join(edited)), (9, " ".join(words).upper() + "\n"), (4, " ".join(far)), (10, " ".join(near)), (8, None), (7, ""), (None, "one two three"), (6, "one two three"), (2, "one  two"), (6, "one two three"), (1, "a b " * 40_000)]
    got = {r.doc_id: (r.class_id, r.copy_of) for r in order_minhash.near_duplicates(frame(spark, docs)).collect()}
    assert got == {5: (3, 5), 3: (3, 3), 9: (3, 5), 4: (4, 4), 10: (3, 10), 8: (7, 7), 7: (7, 7), None: (None, None), 6: (None, None), 2: (2, 2), 1: (1, 1)}
    one = order_minhash.one_of_each(frame(spark, docs))
    assert one.columns == frame(spark, docs).columns and sorted(r.doc_id or 0 for r in one.collect()) == [0, 1, 2, 3, 4, 7]
    assert order_minhash.near_duplicates(frame(spark, [])).count() == 0
    # What lies in both in another order counts once for the order that holds most.
    a, b = (order_minhash.Shingles()(" ".join(x))[0] for x in (words, moved))
    assert order_minhash.aligned(a, b, 0.3) == pytest.approx(150 / (300 * 2 - 150))


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_alignment_of_words():
    rng = random.Random(4)
    for _ in range(400):
        a = [rng.randrange(rng.choice([2, 5, 90])) for _ in range(rng.randrange(60))]
        b = [x for x in a if rng.random() < rng.choice([0.7, 0.95, 1])]
        for _ in range(rng.randrange(6)):
            b.insert(rng.randrange(len(b) + 1), rng.randrange(90))
        m = longest_common(a, b)
        want = m / (len(a) + len(b) - m) if a or b else 0.0
        assert order_minhash.common(a, b, 70) == m
        for least in (0.5, 0.8, 0.95):
            got = order_minhash.aligned(np.array(a, np.uint32), np.array(b, np.uint32), least)
            assert (got >= least - 1e-9) == (want >= least - 1e-9) and (got < least - 1e-9 or got == pytest.approx(want))


def test_texts_of_one_id_stay_apart(spark):
    rng = random.Random(2)
    one, two, three = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(3))
    near = one.replace(one.split()[30], "other")
    docs = frame(spark, [(None, one), (None, two), (None, two), (None, ""), (4, two), (5, three), (5, near), (5, one), (6, three)])
    kept = [r.text for r in order_minhash.one_of_each(docs).collect()]
    assert len(kept) == 4 and {*kept} >= {two, "", three} and order_minhash.one_of_each(docs).columns == docs.columns
    got = {(r.doc_id, r.class_id) for r in order_minhash.near_duplicates(docs).collect()}
    assert got == {(None, None), (4, None), (5, 5), (5, None), (6, 5)}
    item = "the quick brown fox jumps over the lazy dog and runs far into the dark wood"
    held = [(None, item), (None, "a clean text without an id"), (7, item), (7, "another text of that id"), (8, None)]
    clean = decontaminate.without_contaminated(frame(spark, held), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {(r.doc_id, r.text) for r in clean.collect()} == {*held[1:2], *held[3:]}


def test_components_of_any_shape(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200), (201, 202)]
    got = {r.node: r.root for r in order_minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert [len({got[i] for i in s}) for s in (range(41), range(100, 160), range(200, 203))] == [1, 1, 1] and len(set(got.values())) == 3


def test_line_rules(spark):
    good = "This is a plain sentence of ten words or a few more."
    docs = [(1, None), (2, ""), (3, good), (4, f"{good}\nHome | About | Contact | Login | Help"), (5, "\n".join(["Home | A | B | C | D"] * 3) + "\nA short end of it."), (6, "a b c d e " * 4), (None, good), (3, good), (7, "x " * 60_000), (8, f"{good}\nAll rights reserved.\n###")]
    got = [(r.doc_id, r.n_words, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.n_bad_lines, r.kept) for r in line_rules.quality(frame(spark, docs)).collect()]
    assert sorted(got, key=lambda r: (r[0] is None, r)) == [
        (1, 0, 0, 0, True, 0, False), (2, 0, 0, 0, True, 0, False), (3, 12, 0, 0, False, 0, True), (3, 12, 0, 0, False, 0, True), (4, 21, 0, 0, False, 1, True),
        (5, 32, 2, 27, True, 3, False), (6, 20, 0, 20, True, 0, False), (7, 60_000, 0, 60_000, True, 0, False), (8, 16, 0, 0, False, 2, True), (None, 12, 0, 0, False, 0, True),
    ]
    assert line_rules.quality(frame(spark, [])).count() == 0


def test_language(spark):
    en, de = "the quick brown fox jumps over the lazy dog and then ", "der schnelle braune fuchs springt über den faulen hund und "
    docs = spark.createDataFrame(
        [(i, (en if i % 2 else de) * (1 + i % 3), "en" if i % 2 else "de") for i in range(80)] + [(100, None, "en"), (101, "", None), (102, "123 !!", "de"), (103, de * 8_000, None), (None, en, None), (5, en, "en"), (104, "日本", None)],
        "doc_id long, text string, lang string",
    ).withColumn("gram", F.lit(1))
    rows = langid.predicted(docs).collect()
    got = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert len(rows) == 87 and all(got[i][0] == ("en" if i % 2 else "de") for i in range(80))
    assert got[100] == got[101] == got[102] == ("und", 0.0) and got[103][0] == "de" and got[None][0] == "en" and got[104][1] == 0.0
    assert {r.lang_pred for r in langid.predicted(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.predicted(docs.limit(0)).count() == 0


def test_more_languages_than_a_mask_has_bits(spark):
    rng = random.Random(9)
    words = {f"l{i:03d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)] for i in range(300)}
    rows = [(i * 10 + k, " ".join(rng.choices(own, k=40)), lang) for i, (lang, own) in enumerate(words.items()) for k in range(4)]
    got = langid.predicted(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    want = {k: lang for k, _, lang in rows}
    assert len(got) == 1200 and sum(r.lang_pred == want[r.doc_id] for r in got if r.held_out) >= 0.97 * sum(r.held_out for r in got)


def test_n_grams_of_long_texts_are_those_of_their_words():
    text = " ".join(f"wort{i}" + "abcdefgh"[i % 8] for i in range(120_000))
    found = np.sort(np.concatenate(list(langid.grams(text))))
    apart = np.sort(np.concatenate([h for part in (text[: text.index(" ", 250_000)], text[text.index(" ", 250_000) :]) for h in langid.grams(part)]))
    assert len(text) > 1_000_000 and np.array_equal(found, apart)


def test_licences(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        (1, "LICENSE", mit), (2, "a/LICENSE", gpl), (3, "a/b/c/x.txt", "Some prose of no licence."), (4, "z/x.txt", None), (5, "a/y.txt", f"Prose. {mit} And much more prose that goes on."),
        (6, None, "plain"), (6, None, "plain"), (None, "a/b/LICENSE", ""), (7, "ab/x", "t " * 60_000), (8, "q/r/s", "the general work is free"), (9, "a/d/w", "Licensed### under$$$ CC%%% BY-NC 4.0."),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumns({"licence": F.lit(1), "score": F.lit(1), "has": F.lit(1)})
    got = {r.doc_id: (r.licence, r.origin, r.licence_dir) for r in licences.licences(docs).collect()}
    assert got == {
        1: ("MIT", "own", None), 2: ("GPL-3.0", "own", None), 3: ("GPL-3.0", "inherited", "a"), 4: ("MIT", "inherited", ""), 5: ("MIT", "own", None), 6: ("MIT", "inherited", ""),
        None: ("GPL-3.0", "inherited", "a"), 7: ("MIT", "inherited", ""), 8: ("MIT", "inherited", ""), 9: ("CC-BY-NC-4.0", "own", None),
    }
    assert licences.licences(docs).count() == 11 and licences.licences(docs.limit(0)).count() == 0
