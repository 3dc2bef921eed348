"""Hard negatives of anchors: rows of another label that score a little less than the anchor's own kind.

Anchors are dealt into groups of similar ones, and each group is joined by a minimum spanning tree on the
distances of its vectors. A candidate is scored against the root. Along an edge from a parent to a
child, a score changes by at most the edge's length times the candidate's norm, so that the parent's score, or
what is known of it, bounds the child's. A child scores anew only the candidates whose bounds overlap one of
its windows; for the others the bounds are handed on.

Two searches use these trees. The first finds an anchor's positives: its window reaches from the
least score worth knowing upward, over rows of its label. The second finds the negatives: a window for
each positive, over rows of other labels. A pass over a fixed share of the rows first finds scores that
enough rows reach, which raise the windows' lower ends. That saves work and never changes results.

Anchors meet rows in tiles of bounded size: parts of both sides are dealt by hash, and each tile is one
group of a cogrouped map. Scores are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

#: Up to here sums of whole numbers are exact as doubles.
_EXACT = 2.0**53
_LEAST, _MOST = -(2**63), 2**63 - 1
#: A missing id in arrays; it comes last, as in an order with nulls last.
_NO_ID = 2**63 - 1
#: Candidates that are bounded at once.
_CHUNK = 4096


def prepared(vectors: DataFrame) -> DataFrame:
    """`vec_id, row, label, q` of the rows that take part; `q` is the vector in whole numbers, `row` tells rows of one id apart.

    Rows with a null label, a null vector, or a component that is null, infinite or no number take no part, and a row
    that comes twice counts once. Components beyond 64 bits count as the largest of them.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    turned = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))

    def whole(x: Column) -> Column:
        scaled = F.least(F.greatest(x.cast("double") * 256, F.lit(float(_LEAST))), F.lit(float(_MOST)))
        # Beyond 53 bits every double is a whole number.
        return F.when(F.abs(scaled) < _EXACT, F.floor(scaled).cast("double")).otherwise(scaled)

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").where("label is not null and embedding is not null").where(finite)
    row = F.xxhash64("vec_id", "label", "embedding").alias("row")
    return rows.select("vec_id", row, turned.alias("label"), F.transform("embedding", whole).alias("q")).dropDuplicates(["vec_id", "row"])


def matrix(column: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """The vectors as rows of doubles; missing places at the end of a shorter vector are 0."""
    lists = column.combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(lengths.max(initial=0)) if width is None else width
    out = np.zeros((len(lists), width))
    out[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors in an order in which parents come first, their parents' places (the root's is its own), and the edges' lengths.

    The root is the vector closest to the mean; the tree is Prim's.
    """
    n = len(vectors)
    root = int(np.argmin(((vectors - vectors.mean(axis=0)) ** 2).sum(axis=1)))
    order, parent, length = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    best, near, free = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool)
    now = root
    for place in range(n):
        order[place], parent[place], length[place] = now, near[now], 0.0 if place == 0 else best[now]
        free[now] = False
        away = np.sqrt(((vectors - vectors[now]) ** 2).sum(axis=1))
        closer = free & (away < best)
        best[closer], near[closer] = away[closer], place
        now = int(np.argmin(np.where(free, best, np.inf)))
    return order, parent, length


class Scores:
    """Inner products of candidates with one vector as whole numbers, exact as long as they fit 64 bits; beyond, the largest that do."""

    def __init__(self, candidates: np.ndarray, largest: float):
        self.candidates, self.norms = candidates, np.sqrt((candidates**2).sum(axis=1))
        self.plain = self.norms.max(initial=0.0) * largest < _EXACT / 2

    def __call__(self, vector: np.ndarray, which: np.ndarray | slice = slice(None)) -> np.ndarray:
        rows = self.candidates[which]
        if self.plain:
            return (rows @ vector).astype(np.int64)
        whole = [int(x) for x in vector]
        return np.array([min(max(sum(int(a) * b for a, b in zip(r, whole, strict=True)), _LEAST), _MOST) for r in rows], np.int64)


def windowed(anchors: dict, rows: dict, same: bool, best: int) -> Iterator[tuple]:
    """Anchor's place, window, and places and scores of the `best` first candidates of every window of every anchor.

    `anchors` are whole trees, parents first: `q, label, row, parent` (places), `edge`, `inner`, and the windows' `low` and `high`.
    """
    q = anchors["q"]
    largest = float(np.sqrt((q**2).sum(axis=1)).max(initial=0.0))
    held: dict[tuple[int, int], list] = {}
    for at in range(0, len(rows["label"]), _CHUNK):
        part = slice(at, at + _CHUNK)
        scores = Scores(rows["q"][part], largest)
        label, row, ids = rows["label"][part], rows["row"][part], rows["vec_id"][part]
        bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for place, parent in enumerate(anchors["parent"]):
            low, high = anchors["low"][place], anchors["high"][place]
            open_ = low <= high
            least, most = low[open_].min(initial=_MOST), high[open_].max(initial=_LEAST)
            which: np.ndarray | slice = slice(None)
            if parent != place:
                lower, upper = bounds[parent]
                # What is known of the parent, an edge further; the second part is room for rounding.
                slack = (anchors["edge"][place] * (1 + 1e-9) + largest * 1e-12) * scores.norms
                lower, upper = lower - slack, upper + slack
                overlap = np.flatnonzero((upper >= least) & (lower <= most)) if open_.any() else np.zeros(0, np.int64)
                # Where most overlap, one product of all is cheaper than picking them out.
                which = overlap if 2 * len(overlap) <= len(lower) else which
            exact = scores(q[place], which)
            if isinstance(which, slice):
                lower = upper = exact.astype(float)
            else:
                lower[which] = upper[which] = exact
            if anchors["inner"][place]:
                bounds[place] = lower, upper
            fits = np.flatnonzero((exact >= least) & (exact <= most))
            near = fits if isinstance(which, slice) else which[fits]
            good = ((label[near] == anchors["label"][place]) == same) & (row[near] != anchors["row"][place])
            near, exact = near[good], exact[fits][good]
            for k in np.flatnonzero(open_):
                mine = (exact >= low[k]) & (exact <= high[k])
                if mine.any():
                    by = np.lexsort((ids[near[mine]], -exact[mine]))[:best]
                    held.setdefault((place, k), []).append((near[mine][by] + at, exact[mine][by]))
    for (place, k), found in held.items():
        some, values = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.lexsort((rows["vec_id"][some], -values))[:best]
        yield place, k, some[by], values[by]


def _schema(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def planted(anchors: DataFrame, keys: list[str], size: int, pivots: int) -> DataFrame:
    """The anchors in trees of about `size`: `tree, place, parent, edge`, and whether an anchor has children (`inner`).

    A tree holds anchors that agree in `keys` and lie nearest to the same pivot; those of a pivot are dealt into as many
    trees as they need. Pivots are at most `pivots` anchors, those of the least hashes, so they travel with the tasks.
    """
    n = min(pivots, -(-anchors.count() // size))
    centres = matrix(anchors.select("q").orderBy(F.xxhash64("vec_id", "row"), "vec_id", "row").limit(n).toArrow().column("q"))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = matrix(pa.chunked_array([batch.column("q")]))
            width = max(own.shape[1], centres.shape[1])
            a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (own, centres))
            pivot = ((b**2).sum(axis=1) - 2 * a @ b.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot, pa.int64())], names=[*batch.schema.names, "pivot"])

    def plant(table: pa.Table) -> pa.Table:
        order, parent, length = spanning_tree(matrix(table.column("q")))
        places = np.arange(len(order))
        table = table.take(pa.array(order))
        for name, values in (("place", places), ("parent", parent), ("edge", length), ("inner", np.isin(places, parent[1:]))):
            table = table.append_column(name, pa.array(values))
        return table

    near = materialise(anchors.mapInArrow(nearest, f"{_schema(anchors)}, pivot long"))
    parts = near.groupBy(*keys, "pivot").agg(F.ceil(F.count("*") / size).alias("parts"))
    dealt = near.join(parts, [*keys, "pivot"]).withColumn("tree", F.xxhash64(*keys, "pivot", F.pmod(F.xxhash64("row"), F.col("parts"))))
    dealt = dealt.select(*anchors.columns, "tree")
    return materialise(dealt.groupBy("tree").applyInArrow(plant, f"{_schema(dealt)}, place long, parent long, edge double, inner boolean"))


def _parts(df: DataFrame, by: str, size: int, name: str) -> DataFrame:
    """Into how many parts of about `size` rows the rows of each value of `by` go."""
    return df.groupBy(by).agg(F.ceil(F.count("*") / size).alias(name))


def in_windows(anchors: DataFrame, rows: DataFrame, same: bool, best: int, tile_anchors: int, tile_rows: int) -> DataFrame:
    """`anchor_id, anchor_row, window, rank, vec_id, row, score`: the `best` first rows of every window, highest score first, ties by id.

    `anchors` are planted and have `windows` (`low, high`); `same` asks for rows of the anchor's label, otherwise for rows of
    other labels. Where labels must agree, tiles lie within labels. Missing ids are `_NO_ID`.
    """
    spread = 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tile_rows = min(tile_rows, max(1024, rows.count() // spread))  # enough tiles for all tasks
    within = F.col("label") if same else F.lit(0).cast("long")
    anchors, rows = anchors.withColumn("within", within), rows.withColumn("within", within)
    tiles = materialise(_parts(anchors, "within", tile_anchors, "columns").join(_parts(rows, "within", tile_rows, "lines"), "within"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = anchors.join(tiles, "within").withColumn("column", F.pmod(F.xxhash64("tree"), F.col("columns"))).withColumn("line", every("lines"))
    right = rows.join(tiles, "within").withColumn("line", F.pmod(F.xxhash64("vec_id", "row"), F.col("lines"))).withColumn("column", every("columns"))
    on, own = ["within", "column", "line"], ["label", "vec_id", "row", "q"]
    left, right = left.select(*on, *own, "tree", "place", "parent", "edge", "inner", "windows"), right.select(*on, *own)
    names = ["anchor_id", "anchor_row", "window", "vec_id", "row", "score"]

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[list] = [[np.zeros(0, np.int64)] for _ in names]
        if len(a) and len(b):
            a = a.sort_by([("tree", "ascending"), ("place", "ascending")])
            q, theirs = matrix(a.column("q")), matrix(b.column("q"))
            width = max(q.shape[1], theirs.shape[1])
            q, theirs = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, theirs))
            _, begin, sizes = np.unique(a.column("tree").to_numpy(), return_index=True, return_counts=True)
            windows = a.column("windows").to_pylist()
            of = {
                "q": q, "parent": a.column("parent").to_numpy() + np.repeat(begin, sizes), "inner": a.column("inner").to_numpy(),
                "low": [np.array([w["low"] for w in x], np.int64) for x in windows], "high": [np.array([w["high"] for w in x], np.int64) for x in windows],
                **{c: a.column(c).to_numpy() for c in ("label", "row", "edge")},
            }
            ids, to = (t.column("vec_id").fill_null(_NO_ID).to_numpy() for t in (a, b))
            candidates = {"q": theirs, "vec_id": to, "label": b.column("label").to_numpy(), "row": b.column("row").to_numpy()}
            for place, k, some, values in windowed(of, candidates, same, best):
                same_for_all = (np.full(len(some), x) for x in (ids[place], of["row"][place], k))
                for held, x in zip(out, (*same_for_all, to[some], candidates["row"][some], values), strict=True):
                    held.append(x)
        return pa.table([pa.array(np.concatenate(x), pa.int64()) for x in out], names=names)

    met = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(meet, ", ".join(f"{n} long" for n in names))
    order = Window.partitionBy("anchor_id", "anchor_row", "window").orderBy(F.desc("score"), "vec_id", "row")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def searched(anchors: DataFrame, rows: DataFrame, same: bool, best: int, share: int, **tiles) -> DataFrame:
    """`in_windows`, after the windows' lower ends are raised to what `best` of about every `share`-th row reach."""
    some = rows.where(F.pmod(F.xxhash64("row"), F.lit(share)) == 0)
    full = in_windows(anchors, some, same, best, **tiles).where(F.col("rank") == best)
    reached = full.groupBy("anchor_id", "anchor_row").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("reached"))
    raised = F.transform("windows", lambda w, i: F.struct(F.greatest(w["low"], F.element_at("reached", i.cast("long"))).alias("low"), w["high"].alias("high")))
    named = anchors.withColumn("anchor_id", F.coalesce("vec_id", F.lit(_NO_ID))).withColumn("anchor_row", F.col("row"))
    higher = named.join(reached, ["anchor_id", "anchor_row"], "left").withColumn("windows", F.when(F.col("reached").isNull(), F.col("windows")).otherwise(raised))
    return in_windows(materialise(higher.select(*anchors.columns)), rows, same, best, **tiles)


def mined(
    vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, share: int = 16, tree: int = 128, pivots: int = 256,
    tile_anchors: int = 16_384, tile_rows: int = 65_536,
) -> DataFrame:
    """`anchor_id, positive_id, rank, negative_id, positive_score, negative_score`: hard negatives of every anchor and positive.

    Anchors are rows whose id is divisible by `every`; their positives are the first `positives` other rows of their label. For
    each of these come the first `negatives` rows of other labels that score from 80 % of its score to all of it; a positive of
    a score below 0 has none. First means the highest score, then the smaller id, a null id last; a null id makes no
    anchor. Shorter vectors are filled up with 0. Rows of one id that differ are rows of their own. An empty table
    gives an empty table.
    """
    tiles = {"tile_anchors": tile_anchors, "tile_rows": tile_rows}
    rows = materialise(prepared(vectors))
    anchors = materialise(rows.where(F.col("vec_id") % every == 0))
    all_scores = F.array(F.struct(F.lit(_LEAST).alias("low"), F.lit(_MOST).alias("high")))
    near = searched(planted(anchors, ["label"], tree, pivots).withColumn("windows", all_scores), rows, True, positives, share, **tiles)
    near = materialise(near.select(
        "anchor_id", "anchor_row", (F.col("rank") - 1).cast("long").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    ))
    # From four fifths, rounded up, to the score; the window of a score below 0 is empty.
    low = F.when(F.col("positive_score") < 0, F.lit(_MOST)).otherwise(F.expr("positive_score - positive_score div 5"))
    windows = near.groupBy("anchor_id", "anchor_row").agg(F.sort_array(F.collect_list(F.struct("window", low.alias("low"), F.col("positive_score").alias("high")))).alias("windows"))
    windows = windows.select(F.col("anchor_id").alias("vec_id"), F.col("anchor_row").alias("row"), F.transform("windows", lambda w: F.struct(w["low"], w["high"])).alias("windows"))
    asking = anchors.join(windows, ["vec_id", "row"])
    found = searched(planted(asking, [], tree, pivots), rows, False, negatives, share, **tiles)
    given = lambda c: F.nullif(F.col(c), F.lit(_NO_ID)).alias(c)
    found = found.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
    return found.join(near, ["anchor_id", "anchor_row", "window"]).select("anchor_id", given("positive_id"), "rank", given("negative_id"), "positive_score", "negative_score")
