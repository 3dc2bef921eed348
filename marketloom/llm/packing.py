"""Best-fit packing of token sequences by linear grouping.

Lengths are small integers, so the whole plan follows from their histogram, which has at most
`capacity` entries whatever the size of the corpus. The driver plans on that histogram; the tasks
only rank their pieces within a length and look their place up.

The plan: lengths above `capacity / large_parts` are sorted and cut into `groups` groups of equal
cardinality, each rounded up to its longest member. Configurations of these few sizes are chosen
one after another, each the fullest that holds the longest size left and as often as the counts
allow. The actual lengths then take the places of the rounded ones, and the shorter lengths go
best-fit, longest first, into the room that is left.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Cache, materialise, texts

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, sequence_id long, offset long"
#: Characters whose normal form, case and class need no tables; texts with others go to the tokenizer whole.
_PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-įı-ňŊ-ž]*")
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^\\sa-z0-9ß-öø-ž]+")
#: Byte-level vocabularies write printable bytes as themselves and the others as letters from U+0100 on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_LETTERS = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class TokenBytes:
    """Token ids of a text as little-endian unsigned 32-bit numbers.

    The vocabulary merges within a word only, so what stands between white space is encoded once and
    kept. Texts beyond the plain characters, or with one of the vocabulary's own marks in them, are
    encoded whole.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.model = self.tokenizer.model
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.chunks = Cache(self._chunk, 700_000)

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a run of plain characters without white space, in lower case."""
        if not chunk.isascii():
            return b"".join(self._word(w.encode().decode("latin-1").translate(_BYTE_LETTERS)) for w in _WORDS.findall(chunk))
        return b"".join(map(self._word, _WORDS.findall(chunk)))

    def _word(self, word: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text) is None or any(m in text for m in self.marks):
            return self._whole(text)
        return b"".join(map(self.chunks.__getitem__, text.lower().split()))


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row per piece of at most `capacity` tokens: where it starts, its length and its ids' checksum.

    Null and empty texts are one piece that holds `end_id` alone. Repeated rows give repeated pieces.
    """
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary)
        for batch in batches:
            out: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((key, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return texts(docs).mapInArrow(cut, PIECES)


_ENCODERS: dict[str, TokenBytes] = {}


def _encoder(vocabulary: str) -> TokenBytes:
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = TokenBytes(vocabulary)
    return _ENCODERS[vocabulary]


class _Plan:
    """Runs of equal places: pieces of a length with ranks from `rank` on go `per` to a sequence."""

    def __init__(self, counts: dict[int, int], capacity: int, groups: int, large_parts: int):
        self.capacity = capacity
        self.rows: list[tuple[int, int, int, int, int, int]] = []  # length, rank, n, sequence, per, offset
        self.left = dict(counts)
        self.used = dict.fromkeys(counts, 0)
        self.sequences = 0
        self.room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: first sequence, how many
        self.open = 0  # bit r: room[r] isn't empty
        large = sorted((x for x in counts if x > capacity // large_parts), reverse=True)
        self._configurations(self._grouped(large, groups))
        for length in sorted((x for x in counts if x <= capacity // large_parts), reverse=True):
            self._best_fit(length, counts[length])

    def _grouped(self, lengths: list[int], groups: int) -> list[list[list[int]]]:
        """The lengths, longest first, as groups of [length, count] of equal cardinality."""
        total = sum(self.left[x] for x in lengths)
        size, out, room = -(-total // groups) if total else 0, [], 0
        for length in lengths:
            n = self.left[length]
            while n:
                if not room:
                    out.append([])
                    room = size
                take = min(n, room)
                out[-1].append([length, take])
                n, room = n - take, room - take
        return out

    def _configurations(self, groups: list[list[list[int]]]) -> None:
        sizes = [g[0][0] for g in groups]
        counts = [sum(n for _, n in g) for g in groups]
        for first in range(len(groups)):
            while counts[first]:
                chosen = self._fullest(first, sizes, counts)
                times = min(counts[g] // k for g, k in chosen.items())
                for g, k in chosen.items():
                    counts[g] -= k * times
                self._substitute(groups, [g for g, k in chosen.items() for _ in range(k)], times)

    def _fullest(self, first: int, sizes: list[int], counts: list[int]) -> dict[int, int]:
        """A fullest configuration of the sizes left that holds size `first`."""
        room = self.capacity - sizes[first]
        by = np.full(room + 1, -1)  # the size that reaches this sum last
        reached = np.zeros(room + 1, dtype=bool)
        reached[0] = True
        before: list[tuple[int, np.ndarray]] = []
        for g in range(first, len(sizes)):
            for _ in range(min(counts[g] - (g == first), room // sizes[g])):
                new = np.zeros_like(reached)
                new[sizes[g] :] = reached[: room + 1 - sizes[g]]
                new &= ~reached
                if not new.any():
                    break
                before.append((g, new))
                reached |= new
                by[new] = len(before) - 1
        at, chosen = int(np.nonzero(reached)[0][-1]), {first: 1}
        while at:
            g = before[by[at]][0]
            chosen[g] = chosen.get(g, 0) + 1
            at -= sizes[g]
        return chosen

    def _substitute(self, groups: list[list[list[int]]], slots: list[int], times: int) -> None:
        """Actual lengths in place of the rounded ones, in runs of sequences of the same lengths."""
        runs = []
        for g in slots:
            run, want = [], times
            while want:
                length, n = groups[g][0]
                take = min(n, want)
                run.append((length, take))
                want -= take
                groups[g][0][1] -= take
                if not groups[g][0][1]:
                    groups[g].pop(0)
            runs.append(run)
        cuts = sorted({c for run in runs for c in np.cumsum([n for _, n in run]).tolist()})
        at, where = 0, [[0, 0] for _ in runs]  # of each slot: run, and how many of it are taken
        for cut in cuts:
            n, offset = cut - at, 0
            for run, w in zip(runs, where, strict=True):
                length = run[w[0]][0]
                self._place(length, n, self.sequences, 1, offset)
                offset += length
                w[1] += n
                if w[1] == run[w[0]][1]:
                    w[0], w[1] = w[0] + 1, 0
            self._keep(self.capacity - offset, self.sequences, n)
            self.sequences += n
            at = cut

    def _place(self, length: int, n: int, sequence: int, per: int, offset: int) -> None:
        self.rows.append((length, self.used[length], n, sequence, per, offset))
        self.used[length] += n

    def _keep(self, room: int, first: int, n: int) -> None:
        if n and room:
            self.room[room].append((first, n))
            self.open |= 1 << room

    def _best_fit(self, length: int, n: int) -> None:
        """Into the least room that holds the length, again and again, as best-fit does one by one."""
        while n:
            fits = self.open >> length
            if fits:
                room = length + ((fits & -fits).bit_length() - 1)
                first, bins = self.room[room].pop()
                if not self.room[room]:
                    self.open &= ~(1 << room)
            else:
                room, first, bins = self.capacity, self.sequences, -(-n // (self.capacity // length))
                self.sequences += bins
            per, offset = room // length, self.capacity - room
            full = min(bins, n // per)
            if full:
                self._place(length, full * per, first, per, offset)
                self._keep(room - per * length, first, full)
                n, first, bins = n - full * per, first + full, bins - full
            if bins and n:  # fewer than `per` are left: one more sequence takes them
                self._place(length, n, first, n, offset)
                self._keep(room - n * length, first, 1)
                n, first, bins = 0, first + 1, bins - 1
            self._keep(room, first, bins)

    def arrays(self) -> dict[str, np.ndarray]:
        table = np.asarray(sorted(self.rows), dtype=np.int64).reshape(-1, 6)
        return {"key": (table[:, 0] << 44) + table[:, 1], "rank": table[:, 1], "sequence": table[:, 3], "per": table[:, 4], "offset": table[:, 5]}


#: Groups, and the part of the capacity above which a length is large. Few groups leave more to best fit, many round less.
GROUPINGS = ((16, 4), (64, 4), (256, 8), (512, 4))


def plan(counts: dict[int, int], capacity: int = 4096, groupings: tuple[tuple[int, int], ...] = GROUPINGS) -> dict[str, np.ndarray]:
    """Places for pieces by length: `counts` has how many there are of each length (at most `capacity` entries).

    The plan is made for each of `groupings` and the one of fewest sequences is taken.
    """
    return min((_Plan(counts, capacity, *g) for g in groupings), key=lambda p: p.sequences).arrays()


def pack(pieces: DataFrame, capacity: int = 4096, groupings: tuple[tuple[int, int], ...] = GROUPINGS) -> DataFrame:
    """`sequence_id` and `offset` for every row of `pieces` (columns of `token_pieces`).

    A length that a third of all rows share is ranked in as many parts as there are shuffle partitions.
    Repeated rows are packed one by one. An empty table gives an empty table.
    """
    spark = pieces.sparkSession
    pieces = materialise(pieces.select("doc_id", "piece", "start", "length", "ids_crc32"))
    counts = {int(r["length"]): int(r["count"]) for r in pieces.groupBy("length").count().collect()}
    places = spark.sparkContext.broadcast(plan(counts, capacity, groupings))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = (
        salted.withColumn("own", F.row_number().over(own)).join(firsts, ["length", "salt"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("own") - 1).alias("rank"))
    )

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = places.value
        for frame in frames:
            length, rank = frame["length"].to_numpy(np.int64), frame.pop("rank").to_numpy(np.int64)
            at = np.searchsorted(p["key"], (length << 44) + rank, side="right") - 1
            i = rank - p["rank"][at]
            yield frame.assign(sequence_id=p["sequence"][at] + i // p["per"][at], offset=p["offset"][at] + i % p["per"][at] * length)

    return ranked.mapInPandas(place, PLACED)
