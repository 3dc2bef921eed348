"""The corpus operators as registered queries, with production parameters, and their plain SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, credentials, decontaminate, hard_negatives, langid, licences, line_dedup, line_rules, order_minhash, packing, personal, quality_gam, substrings
from .common import shared_folder

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(packing.token_pieces(table(spark, folder, "documents"), VOCABULARY))


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.dedup(table(spark, folder, "documents"), shared_folder(spark, "line-runs"))
    return kept.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return credentials.digest(credentials.secrets(table(spark, folder, "documents")))


def op5_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal.digest(personal.personal_data(table(spark, folder, "documents")))


def op6_quality_gam(spark: SparkSession, folder: str) -> DataFrame:
    return quality_gam.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.predicted(table(spark, folder, "documents"))


def op7_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, folder, "documents"))


def op8_line_rules(spark: SparkSession, folder: str) -> DataFrame:
    return line_rules.quality(table(spark, folder, "documents")).drop("clean")


def op10_licences(spark: SparkSession, folder: str) -> DataFrame:
    """Documents lie at source/language/id."""
    docs = table(spark, folder, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.col("doc_id").cast("string"))
    return licences.licences(docs.select("doc_id", path.alias("path"), "text"))


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives.mined(table(spark, folder, "embeddings"))


def op12_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.deduplicated(table(spark, folder, "documents"))


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


LINE_DEDUP_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), frequent AS (
  SELECT key, max(doc_id) AS largest FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.largest AS dropped FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_CHARS = "length(regexp_replace({}, '[\\x20\\x09-\\x0D]+', '', 'g'))"
LINE_RULES_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT doc_id, w, unnest(range(len(w) - 4)) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM docs)
), windows AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 5], ' ') AS five FROM words),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, five) > 1),
repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest(range(5)) AS k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, line, trim(line, {_SPACE}) AS bare
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)
), checked AS (
  SELECT doc_id, line, {_CHARS.format("bare")} AS chars,
    NOT regexp_matches(bare, '\\pL')
    OR len(regexp_extract_all(bare, '[#*$%&|<>]')) * 10 >= {_CHARS.format("bare")}
    OR len(regexp_extract_all(bare, '[!?]{{2,}}')) * 4 >= len(regexp_extract_all(bare, '[^\\x20\\x09-\\x0D]+'))
    OR len(regexp_extract_all(bare, '[ \\t][|»·>][ \\t]')) >= 3
    OR regexp_matches(bare, '{line_rules.MENU}') OR regexp_matches(lower(bare), '{"|".join(line_rules.BOILERPLATE)}') AS fails
  FROM lines WHERE bare <> ''
), by_doc AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (fails) AS n_bad_lines,
    coalesce(sum(chars) FILTER (NOT fails), 0) AS left_chars
  FROM checked GROUP BY doc_id
), counted AS (
  SELECT doc_id, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n_words, {_CHARS.format("text")} AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_bad_lines, 0) AS n_bad_lines, coalesce(left_chars, 0) AS left_chars
  FROM docs LEFT JOIN by_doc USING (doc_id) LEFT JOIN repeated USING (doc_id)
), judged AS (SELECT *, n_words < 10 OR n_repeat_words * 100 > n_words * 20 AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_bad_lines,
  NOT base_failed AND left_chars >= word_chars * 0.5 AS kept
FROM judged
"""


HARD_NEGATIVES_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
  FROM (SELECT DISTINCT vec_id, label, embedding FROM embeddings)
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.q, r.q)::BIGINT AS score
  FROM rows a, rows r WHERE a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same
  AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""

SUBSTRING_SQL = """
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS passage FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM words)
), again AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY passage) > 1
), gone AS (
  SELECT DISTINCT doc_id, i + k AS pos FROM again, (SELECT unnest(range(35)) AS k)
), each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM words),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS kept FROM each ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

AUDIT_SQL = """
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), firsts AS (
  SELECT text, min(doc_id) AS first FROM texts GROUP BY text
), counted AS (
  SELECT doc_id, part, text, len(words) AS n, len(list_distinct(words)) AS d
  FROM (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM texts)
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [
    n < 200, 100 * d < 50 * n, 100 * length(regexp_replace(c.text, '[^A-Z]', '', 'g')) > 3 * length(c.text),
    regexp_matches(c.text, '[#$%&*|]'), coalesce(f.first < c.doc_id, false)] AS fails
  FROM counted c JOIN firsts f ON c.text = f.text LEFT JOIN marks m ON c.doc_id = m.doc_id
), classes AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, fails
), letters AS (SELECT unnest(range(1, 6)) AS f), orders AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS turns FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), applied AS (
  SELECT part, turns, step, turns[step] AS f, n, good, toxic, fails[turns[step]] AS fails_it,
    list_contains([fails[t] FOR t IN turns[1 : step - 1]], true) AS gone, len([x FOR x IN fails IF x]) AS n_fails
  FROM classes, orders, (SELECT unnest(range(1, 6)) AS step)
), per_step AS (
  SELECT part, turns, step, f, coalesce(sum(n) FILTER (NOT gone AND NOT fails_it), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (NOT gone AND fails_it), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (gone AND fails_it), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails_it AND n_fails = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND fails_it), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (NOT gone AND fails_it), 0)::BIGINT AS toxic_lost
  FROM applied GROUP BY part, turns, step, f
)
SELECT part, array_to_string(['ABCDE'[t] FOR t IN turns], '') AS filter_order, step::INT AS step, kept, removed, redundant, unique_fails,
  good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM per_step
"""

QUERIES = {f.__name__: f for f in (op1_packing, op2_line_dedup, op3_decontamination, op4_secrets, op5_personal_data, op6_quality_gam, op7_order_minhash, op8_line_rules, op9_language_id, op10_licences, op11_hard_negatives, op12_substring_dedup, op13_filter_audit)}
SQL: dict[str, str] = {"op2_line_dedup": LINE_DEDUP_SQL, "op8_line_rules": LINE_RULES_SQL, "op11_hard_negatives": HARD_NEGATIVES_SQL, "op12_substring_dedup": SUBSTRING_SQL, "op13_filter_audit": AUDIT_SQL}
