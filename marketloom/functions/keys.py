"""Surrogate keys and deterministic ids."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def surrogate_key(*parts: Column, sep: str = "||") -> Column:
    """md5 of the joined natural key. NULL if any part is NULL, so unmatched rows keep a NULL key."""
    pieces: list[Column] = []
    for part in parts:
        if pieces:
            pieces.append(F.lit(sep))
        pieces.append(part.cast("string"))
    return F.md5(F.concat(*pieces).cast("binary"))


def content_key(first: Column, *fields: Column, text: Column, head: int | None = None, sep: str = "") -> Column:
    """md5 over a required field, optional fields and a whole text.

    `head` keys on the first characters only, for ids of a store that was keyed so; texts that
    differ later then share a key.
    """
    optional = [F.coalesce(f.cast("string"), F.lit("")) for f in fields]
    whole = F.coalesce(text, F.lit(""))
    optional.append(whole if head is None else F.left(whole, F.lit(head)))
    joined = F.concat_ws(sep, *optional)
    return F.md5(F.concat(first.cast("string"), F.lit(sep), joined).cast("binary"))


def file_key(content: Column) -> Column:
    """sha256 of raw bytes (or of the UTF-8 bytes of a string)."""
    return F.sha2(content.cast("binary"), 256)


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """RFC 4122 version-5 id of `name` in `namespace`, equal to Python's `uuid.uuid5`."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), name.cast("string").cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"),
        F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )
