"""Quality rules, line first.

Each line is held against rules on punctuation, navigation and boilerplate; lines that fail are
taken out, and a document that loses too much of its text so is rejected, as are documents that are
too short or repeat themselves. All of it is computed within the row: no text is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

_GAP = r"[\x20\x09-\x0D]+"
_SYMBOLS = "[#*$%&|<>]+"
#: Phrases of page furniture, in lower case.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "click here", "sign up for our",
    "subscribe to our", "enable javascript", "powered by", "lorem ipsum", "alle rechte vorbehalten", "tous droits réservés", "todos los derechos reservados",
)
#: A line of up to four of these words is a menu.
MENU = r"(?i)^(?:home|about|about us|contact|contact us|login|log in|sign in|sign up|register|search|menu|next|previous|back|top|share|help|faq|sitemap)(?:[\x20\x09,/>»·-]+(?:home|about|about us|contact|contact us|login|log in|sign in|sign up|register|search|menu|next|previous|back|top|share|help|faq|sitemap)){0,3}$"
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_bad_lines", "kept")


def line_fails(line: Column) -> Column:
    """Whether a line, stripped, fails a rule.

    Punctuation: no letter at all, symbols of at least a tenth of its characters, or doubled
    exclamation or question marks on at least every fourth word. Navigation: three separators of
    a menu or more, or menu words alone. Boilerplate: a phrase of page furniture.
    """
    chars = F.length(F.regexp_replace(line, _GAP, F.lit("")))
    marks = lambda pattern: F.size(F.regexp_extract_all(line, F.lit(pattern), F.lit(0)))
    words = marks(_GAP) + 1
    symbols = F.length(line) - F.length(F.regexp_replace(line, _SYMBOLS, F.lit("")))
    # Looked for one by one, as a pattern of alternatives would be tried at every character; the one-element array binds the lower case.
    said = lambda low: reduce(lambda a, b: a | b, (F.contains(low, F.lit(phrase)) for phrase in BOILERPLATE))
    furniture = F.get(F.transform(F.array(F.lower(line)), said), F.lit(0))
    return (
        ~line.rlike(r"\p{L}") | (symbols * 10 >= chars) | (marks("[!?]{2,}") * 4 >= words)
        | (marks(r"[\x20\x09][|»·>][\x20\x09]") >= 3) | line.rlike(MENU) | furniture
    )


def quality(docs: DataFrame, most_lost: float = 0.5, fewest_words: int = 10, most_repeated: float = 0.2, window: int = 5) -> DataFrame:
    """The counts, `base_failed` and the verdict `kept` of every row, with `doc_id` and the text that is left as `clean`.

    Null and empty texts have no words and are rejected. Every row has one result, repeated rows too.
    A document is rejected if the lines that fail hold more than `most_lost` of its characters.
    """
    kind = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    first = kind.withColumn("words", F.filter(F.split("text", _GAP, -1), lambda w: w != "")).withColumn(
        "lines", F.filter(F.transform(F.split("text", "\n", -1), lambda line: F.struct(line.alias("line"), F.btrim(line, F.lit(SPACE)).alias("bare"))), lambda s: s["bare"] != "")
    )
    n = F.size("words")
    windows = F.when(n >= window, F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(F.slice("words", i + 1, window))))
    second = first.select(
        "doc_id", "text", "lines", n.cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.coalesce(windows, F.array().cast("array<bigint>")).alias("windows"), F.transform("lines", lambda s: line_fails(s["bare"])).alias("fails"),
    )
    # Only a text with a window twice has its windows sorted.
    ordered = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    third = second.withColumn("ordered", ordered).drop("windows")
    same = lambda x, k: F.coalesce(F.get(F.col("ordered"), k)["h"] == x["h"], F.lit(False))
    places = F.array_sort(F.transform(F.filter("ordered", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))
    covered = F.aggregate(
        places, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + i + window - F.greatest(a["end"], i)).alias("n"), (i + window).alias("end")), lambda a: a["n"],
    )
    raw = F.col("lines")["line"]
    chars = lambda lines: F.coalesce(F.length(F.regexp_replace(F.array_join(lines, ""), _GAP, F.lit(""))), F.lit(0))
    left = F.transform(F.filter(F.arrays_zip("lines", "fails"), lambda z: ~z["fails"]), lambda z: z["lines"]["line"])
    fourth = third.select(
        "doc_id", "n_words", "word_chars",
        (F.length("text") - F.length(F.regexp_replace("text", _SYMBOLS, F.lit("")))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct(raw))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(F.filter("fails", lambda x: x)).cast("long").alias("n_bad_lines"), left.alias("left"),
    )
    failed = (F.col("n_words") < fewest_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * round(most_repeated * 100))
    return fourth.withColumn("base_failed", failed).withColumn("left_chars", chars(F.col("left"))).select(
        "doc_id", *COLUMNS[:-1], (~F.col("base_failed") & (F.col("left_chars") >= F.col("word_chars") * (1 - most_lost))).alias("kept"),
        F.array_join("left", "\n").alias("clean"),
    )
