"""Personal data by weak supervision.

Candidates are the strict forms of four kinds and looser forms of five more. Labelers by form,
gazetteer and context vote for, against or not at all on every candidate. Expectation-maximisation
on the counts of the vote patterns estimates how reliable each labeler is, and its posteriors train
a classifier on votes, kind and length that decides on the loose candidates; strict ones stay.

There are at most 9 * 4 * 3 ** 5 patterns of votes, kind and length, so what reaches the driver is
bounded whatever the size of the corpus, and their counts cover every candidate in it.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .spans import DOCUMENT, joined_spans, located

#: Strict kinds in the order of ties, and their patterns (fixed in what they match; starts that can't match are passed over).
STRICT = ("email", "ip", "card", "phone")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Loose kinds.
SPELLED = r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}\x20?[(\[](?:at|AT)[)\]]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[(\[](?:dot|DOT)[)\]])\x20?[A-Za-z0-9-]{1,63}){1,5}+"
LOCAL = r"(?<![0-9A-Za-z+(.-])\(?[0-9]{3}\)?[\x20.-]\x20?[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])"
NATIONAL = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
ACCOUNT = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])"
PERSON = r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z][a-z]{1,30}(?:\x20[A-Z][a-z]{1,30})?"
LOOSE = ("spelled", "local", "national", "account", "person")
KINDS = STRICT + LOOSE

#: Gazetteers: top-level domains, country codes of telephones and of bank accounts, given names.
DOMAINS = "com org net edu gov info io de fr es it nl uk us eu ch at".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 54 55 61 62 81 82 86 90 91".split()
BANKS = "AT BE CH DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split()
NAMES = "Anna Carlos David Elena Emma Hans Jean John Jose Julia Karl Laura Maria Marie Mark Mary Michael Paul Peter Pierre Robert Sarah Thomas".split()
_FOR = r"(?i)(?:phone|tel|call|mobile|fax|contact|mail|reach|write to|ssn|social security|iban|account|card|visa|address|name|dear|signed|telefon|correo|courriel)[^\n]{0,25}$"
_AGAINST = r"(?i)(?:version|release|build|rev|isbn|order|invoice|part|model|page|section|figure|token|hash|=|#|/)[^\nA-Za-z0-9]{0,4}$"
LABELERS = ("form", "gazetteer", "context", "technical", "edges")


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def value(c: Column, i: Column) -> Column:
        n = F.coalesce(c.try_cast("int"), F.lit(0))
        return F.when(i % 2 == 0, n).otherwise(n * 2 - F.when(n > 4, 9).otherwise(0))

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid() -> Column:
    """What a strict match must meet beyond its pattern."""
    found, kind, digits = F.col("found"), F.col("kind"), F.length(_digits(F.col("found")))
    return (
        F.when(kind == "ip", F.forall(F.split(found, r"\."), lambda p: p.cast("double") <= 255))
        .when(kind == "card", digits.between(14, 19) & luhn(_digits(found)))
        .when(kind == "phone", digits.between(10, 15)).otherwise(True)
    )


def votes() -> dict[str, Column]:
    """1 for, -1 against, 0 no vote: a column of each labeler over `kind`, `found`, `left` and `right`."""
    kind, found, left, right = (F.col(c) for c in ("kind", "found", "left", "right"))
    digits = _digits(found)
    yes_no = lambda c: F.when(c, 1).otherwise(-1)
    return {
        "form": F.when(kind == "card", yes_no(digits.rlike("^[3-6]"))).when(kind == "ip", yes_no(found.rlike(r"^(?!0|127|255)")))
        .when(kind.isin("local", "phone"), yes_no(found.rlike(r"\([0-9]{3}\)|^[0-9+]+(?:[\x20.-])[0-9]+(?:[\x20.-])[0-9]+$")))
        .when(kind == "national", yes_no(~found.rlike("^(?:000|666|9)|-00-|0000$"))).when(kind.isin("email", "spelled"), yes_no(found.rlike("[A-Za-z]{2,}[)]?$"))).otherwise(0),
        "gazetteer": F.when(kind.isin("email", "spelled"), yes_no(F.lower(F.regexp_extract(found, "([A-Za-z0-9]+)$", 1)).isin(DOMAINS)))
        .when(kind == "phone", yes_no(F.substring(digits, 1, 1).isin(CALLING) | F.substring(digits, 1, 2).isin(CALLING)))
        .when(kind == "account", yes_no(F.substring(found, 1, 2).isin(BANKS)))
        .when((kind == "person") & F.regexp_extract(found, r"\x20([A-Z][a-z]+)", 1).isin(NAMES), 1).otherwise(0),
        "context": F.when(left.rlike(_FOR), 1).otherwise(0),
        "technical": F.when(left.rlike(_AGAINST), -1).otherwise(0),
        "edges": yes_no((left.rlike(r"(?:^|[\s(\[\"'<:,;])$")) & (right.rlike(r"^(?:$|[\s)\]\"'>:,;.!?])"))),
    }


def reliabilities(patterns: list[tuple[tuple[str, int, tuple[int, ...]], int]], rounds: int = 50) -> tuple[dict, dict]:
    """Expectation-maximisation on counted patterns ((kind, length, votes), n).

    Gives the chance of every vote of each labeler if the candidate is personal data and if it is
    not, and the posterior of each pattern. Votes count alike in the first round.
    """
    posterior = {p: min(0.95, max(0.05, 0.5 + 0.2 * sum(p[2]))) for p, _ in patterns}
    chances: dict = {}
    for _ in range(rounds):
        weight: dict = defaultdict(lambda: [0.5, 0.5])  # half a vote of each sort in advance
        share: dict = defaultdict(lambda: [1.0, 1.0])
        for p, n in patterns:
            for side, w in enumerate((n * (1 - posterior[p]), n * posterior[p])):
                share[p[0]][side] += w
                for i, v in enumerate(p[2]):
                    weight[i, v][side] += w
        chances = {}
        for i in range(len(LABELERS)):
            totals = [sum(weight[i, v][side] for v in (-1, 0, 1)) for side in (0, 1)]
            for v in (-1, 0, 1):
                chances[i, v] = [weight[i, v][side] / totals[side] for side in (0, 1)]
        for p, _ in patterns:
            odds = math.log(share[p[0]][1] / share[p[0]][0]) + sum(math.log(chances[i, v][1] / chances[i, v][0]) for i, v in enumerate(p[2]))
            posterior[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return chances, posterior


def classifier(patterns: list[tuple[tuple[str, int, tuple[int, ...]], int]], posterior: dict) -> dict[str, float]:
    """Log odds by feature of a naive Bayes classifier trained on the posteriors; "" is the intercept."""
    counts: dict = defaultdict(lambda: [1.0, 1.0])
    for p, n in patterns:
        for feature in ("", *_features(p)):
            counts[feature][0] += n * (1 - posterior[p])
            counts[feature][1] += n * posterior[p]
    base = math.log(counts[""][1] / counts[""][0])
    return {f: math.log(c[1] / c[0]) - (base if f else 0.0) for f, c in counts.items()}


def _features(pattern: tuple[str, int, tuple[int, ...]]) -> list[str]:
    kind, length, given = pattern
    return [f"kind={kind}/{length}", *(f"{name}={vote}" for name, vote in zip(LABELERS, given, strict=True))]


def personal_data(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """`doc_id, base, added` per document: the strict spans, and the loose ones that the classifier takes.

    Spans are structs (start, rank, kind, end) in code points, end exclusive. Null and empty texts
    have none; rows of one id and text are one document; without any candidate nothing is learnt.
    """
    has_digit, any_of = F.col("text").rlike("[0-9]"), lambda *xs: F.col("text").rlike("|".join(xs))
    found = located(docs, [
        ("email", EMAIL, F.contains("text", F.lit("@"))), ("ip", IP, has_digit), ("card", CARD, has_digit), ("phone", PHONE, F.contains("text", F.lit("+"))),
        ("spelled", SPELLED, any_of(r"[(\[](?:at|AT)[)\]]")), ("local", LOCAL, has_digit), ("national", NATIONAL, has_digit),
        ("account", ACCOUNT, has_digit), ("person", PERSON, any_of("Mr", "Ms", "Dr", "Prof")),
    ])
    length = F.least(F.lit(3), F.floor(F.length("found") / 8)).cast("int")
    candidates = materialise(
        found.select(*DOCUMENT, F.when(_valid(), F.col("kind")).alias("kind"), "start", "end", length.alias("length"), F.array(*votes().values()).alias("votes"))
    )  # a match that fails leaves its document with a row
    counted = candidates.where("kind is not null").groupBy("kind", "length", "votes").count().collect()  # bounded by the patterns there are
    patterns = [((r["kind"], r["length"], tuple(r["votes"])), r["count"]) for r in counted]
    odds = classifier(patterns, reliabilities(patterns)[1])
    known = F.create_map(*(x for f, o in odds.items() for x in (F.lit(f), F.lit(float(o))))) if odds else F.create_map(F.lit(""), F.lit(0.0))
    feature = lambda key: F.coalesce(F.element_at(known, key), F.lit(0.0))
    log_odds = feature(F.lit("")) + feature(F.concat(F.lit("kind="), "kind", F.lit("/"), F.col("length").cast("string")))
    for i, name in enumerate(LABELERS):
        log_odds = log_odds + feature(F.concat(F.lit(f"{name}="), F.get("votes", F.lit(i)).cast("string")))
    rank = F.element_at(F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i)))), F.col("kind"))
    span = F.struct("start", rank.alias("rank"), "kind", "end")
    strict = F.col("kind").isin(*STRICT)
    return candidates.withColumn("p", 1 / (1 + F.exp(-log_odds))).groupBy(*DOCUMENT).agg(
        F.collect_list(F.when(strict, span)).alias("base"), F.collect_list(F.when(~strict & (F.col("p") >= threshold), span)).alias("added"),
    ).drop("_same")


def digest(found: DataFrame) -> DataFrame:
    """Counts and spans per document, as the query returns them."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *(count(k) for k in STRICT), F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"),
        joined_spans(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )
