"""Secret scan with multipart credential linking.

Three strong kinds stand on their own: an assignment to a secret's name, an access id and a long
hexadecimal number. Weak candidates mean something only together: an account or client id, a token
that looks random, an endpoint. Each part reaches `reach` code points to either side, within its scope;
a login or an endpoint is reported if a secret lies in its reach, a random token if a login or an
endpoint does. Blank lines, rulers, section heads and `}, {` end a scope. The join of these intervals
looks at the nearest part of each role that ends before and that starts after only, so it sorts the
parts of a scope and no more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .spans import DOCUMENT, joined_spans, located

#: Strong kinds in the order of ties, and their patterns (fixed). Possessive runs, as nothing follows them.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"
#: Weak kinds.
LOGIN = r"""(?i:user(?:name)?|login|account(?:_?id)?|client_?id|tenant_?id|access_?key_?id)["']?\x20{0,4}[:=]\x20{0,4}["']?[A-Za-z0-9._@-]{3,}+"""
RANDOM = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{20,}+={0,2}+"
ENDPOINT = r"(?i:https?|s3|gs|jdbc:[a-z]{2,12}|mongodb|redis|amqp|postgres(?:ql)?|mysql)://[A-Za-z0-9._:@/-]{4,}+"
#: What ends a scope: a blank line, a ruler, a section head, one block closed and the next opened.
SCOPE = r"\n[\x20\t\r]*+(?=\n)|\n(?:-{3,}+|={3,}+|\*{3,}+)|\n\[[^\]\n]{1,200}+\]|\}[\x20\t\r\n]*+,?[\x20\t\r\n]*+\{"
_STRONG = ("assign", "access", "hex")
_ROLES = {"assign": "secret", "access": "login", "hex": "secret", "login": "login", "random": "secret", "endpoint": "endpoint"}


def _has(*needles: str) -> Column:
    low = F.lower("text")
    found = F.lit(False)
    for needle in needles:
        found = found | F.contains(low, F.lit(needle))
    return found


def _rank(kind: Column) -> Column:
    return F.element_at(F.create_map(*(x for i, k in enumerate(_ROLES) for x in (F.lit(k), F.lit(i)))), kind)


def secrets(docs: DataFrame, reach: int = 200) -> DataFrame:
    """`doc_id, base, linked` per document: the strong spans and the weak ones that are linked, as arrays.

    Spans are structs (start, rank, kind, end) in code points, end exclusive. Null and empty texts
    have none; rows of one id and text are one document.
    """
    text_has_sign = F.contains("text", F.lit("=")) | F.contains("text", F.lit(":"))
    parts = located(docs, [
        ("assign", ASSIGN, text_has_sign & _has("passw", "secret", "token", "api")), ("access", ACCESS, F.contains("text", F.lit("AKIA"))), ("hex", HEX, None),
        ("login", LOGIN, text_has_sign & _has("user", "login", "account", "client", "tenant", "access")),
        ("random", RANDOM, None), ("endpoint", ENDPOINT, F.contains("text", F.lit("://"))),
        ("scope", SCOPE, F.contains("text", F.lit("://")) | text_has_sign & _has("user", "login", "account", "client", "tenant", "access")),
    ])
    parts = parts.withColumns({"mark": F.coalesce(F.col("kind") == "scope", F.lit(False)), "kind": F.nullif("kind", F.lit("scope"))})
    value = F.regexp_extract("found", r"""[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$""", 1)
    # A match that fails leaves its document with a row.
    parts = parts.withColumn("kind", F.when((F.col("kind") != "assign") | (F.length(value) >= 12), F.col("kind")))
    parts = parts.withColumn("role", F.element_at(F.create_map(*(F.lit(x) for kv in _ROLES.items() for x in kv)), F.col("kind")))
    # Each part is two events, its start and its end, so that parts that overlap do not hide those beside them.
    events = F.array(*(F.struct(F.lit(x).alias("event"), F.col(x).alias("at")) for x in ("start", "end")))
    parts = parts.select("*", F.inline(events))
    # No part holds a mark, so both its ends lie in one scope.
    marked = F.count_if(F.col("mark") & (F.col("event") == "end")).over(Window.partitionBy(*DOCUMENT).orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    parts = parts.withColumn("scope", marked)
    scope = Window.partitionBy(*DOCUMENT, "scope")
    earlier, later = (scope.orderBy(c).rangeBetween(Window.unboundedPreceding, Window.currentRow) for c in (F.col("at").asc(), F.col("at").desc()))
    near = F.lit(False)
    for role in ("login", "secret", "endpoint"):
        # One of two parts must be a secret.
        other = (F.col("role") != role) & ((F.col("role") == "secret") | F.lit(role == "secret"))
        # A part that lies inside another isn't one of two parts.
        before = F.max(F.when((F.col("role") == role) & (F.col("event") == "end"), F.col("at"))).over(earlier)
        after = F.min(F.when((F.col("role") == role) & (F.col("event") == "start"), F.col("at"))).over(later)
        gap = F.when(F.col("event") == "start", F.col("at") - before).otherwise(after - F.col("at"))
        near = near | (other & F.coalesce(gap <= reach, F.lit(False)))
    strong = F.col("kind").isin(*_STRONG)
    span = F.struct("start", _rank(F.col("kind")).alias("rank"), "kind", "end")
    return parts.withColumn("near", near).groupBy(*DOCUMENT).agg(
        F.collect_list(F.when(strong & (F.col("event") == "start"), span)).alias("base"), F.collect_set(F.when(~strong & F.col("near"), span)).alias("linked"),
    ).drop("_same")


def digest(found: DataFrame) -> DataFrame:
    """Counts and spans per document, as the query returns them."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *(count(k) for k in _STRONG), F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"),
        joined_spans(F.concat("base", "linked")).alias("spans"), F.size("linked").cast("long").alias("n_linked"),
    )
