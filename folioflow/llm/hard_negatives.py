"""Hard negatives: for each anchor and each of its best positives, the best other-label rows in a window of scores.

Rows become integer vectors in JVM expressions and are dealt into tiles of bounded size by a hash of their row number.
Anchor tiles and candidate tiles meet by an equi-join on the pair of tile numbers (each tile is sent to its row or column of
the grid), so no task holds more than one tile of each kind, nothing is broadcast and nothing passes through the driver. A
pair's scores are one Strassen product: both tiles are padded with zeros, halved again and again, and seven products of
halves make four; sums and differences are exact in int64. Where the operands prove that no sum of a leaf passes 2^53, the
leaf's products run on floating-point units, which are exact there; else in int64.

The first pass keeps for each anchor the heap of its `positives` best rows of its label, the second for each positive the
heap of the `negatives` best rows of other labels whose scores lie in the positive's window. Heaps of one anchor merge over
the tiles that a task meets in a row, then over tasks by ranks in its window of at most so many rows for each task.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part; rows without a vec_id
are candidates with the id -1 and no anchors; repeated rows are rows of their own, also as anchors, and a row's repetition
is another row; vectors of different lengths are compared as if filled up with zeros, an empty one scores 0; scores are
exact while they and all components fit in 64 bits; ties go to the smaller id, and among rows of one id to any; other columns are not looked at;
an empty table, and one without anchors, gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioflow.llm.common import stored

POSITIVES, NEGATIVES = 5, 10
#: The window, as shares of the positive's score in percent.
LOW, HIGH = 30, 90
#: Rows of a tile, about; a tile's scores are ANCHORS x CANDIDATES numbers.
ANCHORS, CANDIDATES = 512, 2048
#: Sides up to which tiles are multiplied without halving.
LEAF = 32


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The int64 product of two int64 matrices (modulo 2^64, so exact where it fits)."""
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    halvings = 0
    while min(m, k, n) >> halvings > leaf:
        halvings += 1
    side = 1 << halvings
    up = lambda x: -(-x // side) * side
    x, y = np.zeros((up(m), up(k)), np.int64), np.zeros((up(k), up(n)), np.int64)
    x[:m, :k], y[:k, :n] = a, b
    most = lambda z: max(abs(int(z.max(initial=0))), abs(int(z.min(initial=0))))
    # each halving at most doubles the operands' entries
    exact = most(x) * most(y) * 4**halvings * k < 1 << 53
    return _product(x, y, halvings, exact)[:m, :n]


def _product(a: np.ndarray, b: np.ndarray, halvings: int, exact: bool) -> np.ndarray:
    if not halvings:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64) if exact else a @ b
    m, k, n = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    of = lambda x, y: _product(x, y, halvings - 1, exact)
    out = np.zeros((2 * m, 2 * n), np.int64)
    c11, c12, c21, c22 = out[:m, :n], out[:m, n:], out[m:, :n], out[m:, n:]
    p = of(a11 + a22, b11 + b22)
    c11 += p
    c22 += p
    p = of(a21 + a22, b11)
    c21 += p
    c22 -= p
    p = of(a11, b12 - b22)
    c12 += p
    c22 += p
    p = of(a22, b21 - b11)
    c11 += p
    c21 += p
    p = of(a11 + a12, b22)
    c11 -= p
    c12 += p
    c22 += of(a21 - a11, b11 + b12)
    c11 += of(a12 - a22, b21 + b22)
    return out


def vectors(df: DataFrame) -> DataFrame:
    """row, id, label, anchor and the integer vector v of each row of df that takes part."""
    finite = "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(cast(x AS double)) < double('infinity'))"
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = df.filter("label IS NOT NULL AND embedding IS NOT NULL").filter(finite)
    rows = rows.select(
        F.coalesce(F.col("vec_id").cast("long"), F.lit(-1).cast("long")).alias("id"),
        label.alias("label"),
        F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)).alias("anchor"),
        F.expr("transform(embedding, x -> cast(floor(256 * cast(x AS double)) AS long))").alias("v"),
    )
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")


def tiles(rows: DataFrame, size: int, *more: str) -> tuple[DataFrame, int]:
    """(tile, rows as an array of structs row, id, label, v and more), and how many tiles there are."""
    n = max(1, -(-rows.count() // size))
    tiled = rows.groupBy(F.pmod(F.xxhash64("row"), F.lit(n)).cast("int").alias("tile")).agg(F.collect_list(F.struct("row", "id", "label", "v", *more)).alias("rows"))
    return tiled, n


def grid(anchors: DataFrame, n_anchors: int, candidates: DataFrame, n_candidates: int) -> DataFrame:
    """Every anchor tile beside every candidate tile: a, c, anchors, candidates."""
    left = anchors.select(F.col("tile").alias("a"), F.col("rows").alias("anchors"), F.explode(F.sequence(F.lit(0), F.lit(n_candidates - 1))).alias("c"))
    right = candidates.select(F.col("tile").alias("c"), F.col("rows").alias("candidates"), F.explode(F.sequence(F.lit(0), F.lit(n_anchors - 1))).alias("a"))
    return left.hint("merge").join(right, ["a", "c"]).select("a", "c", "anchors", "candidates")


class Tile:
    """A tile's rows as arrays, by rising id."""

    def __init__(self, rows: pa.ListArray, k: int):
        found = rows.slice(k, 1).flatten()
        self.row, self.id, self.label = (found.field(x).to_numpy(zero_copy_only=False) for x in ("row", "id", "label"))
        v = found.field("v")
        n = pa.compute.list_value_length(v).to_numpy(zero_copy_only=False).astype(np.int64)
        self.v = np.zeros((len(n), int(n.max(initial=0))), np.int64)
        at = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.v[at] = v.flatten().to_numpy(zero_copy_only=False)
        self.positives = found.field("positives").to_pylist() if "positives" in [f.name for f in found.type] else None
        order = np.lexsort((self.row, self.id))
        self.row, self.id, self.label, self.v = (x[order] for x in (self.row, self.id, self.label, self.v))
        if self.positives:
            self.positives = [self.positives[i] for i in order]


def scores(a: Tile, c: Tile, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    width = min(a.v.shape[1], c.v.shape[1])
    return strassen(a.v[rows, :width], np.ascontiguousarray(c.v[cols, :width].T))


def merged(old: tuple | None, new: tuple, size: int) -> tuple:
    """Two heaps, each (slot, score, id) arrays, as one with the `size` best of each slot: higher score, then smaller id."""
    slot, score, ids = new if old is None else tuple(np.concatenate(x) for x in zip(old, new, strict=True))
    order = np.lexsort((ids, ~score, slot))
    slot, score, ids = slot[order], score[order], ids[order]
    first = np.searchsorted(slot, slot, "left")
    keep = np.arange(len(slot)) - first < size
    return slot[keep], score[keep], ids[keep]


def _by_label(a: Tile) -> Iterator[tuple[int, np.ndarray]]:
    for label in np.unique(a.label).tolist():
        yield label, np.flatnonzero(a.label == label)


def positive_heap(a: Tile, c: Tile, size: int) -> tuple:
    """(anchor row, score, id) of each anchor's best rows of its label in a candidate tile."""
    out = []
    for label, rows in _by_label(a):
        cols = np.flatnonzero(c.label == label)
        if not len(cols):
            continue
        s = scores(a, c, rows, cols)
        # candidates ascend by id, so a stable order by score alone has the ties right; one more for the anchor itself
        order = np.argsort(~s, axis=1, kind="stable")[:, : size + 1]
        slot = np.repeat(a.row[rows], order.shape[1])
        score, at = np.take_along_axis(s, order, 1).ravel(), cols[order].ravel()
        other = c.row[at] != slot
        out.append((slot[other], score[other], c.id[at][other]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(3))


def negative_heap(a: Tile, c: Tile, size: int, low: int, high: int) -> tuple:
    """(anchor's place * slots + positive's place, score, id) of the best rows of other labels within each positive's window."""
    out, slots = [], slots_of(a)
    for label, rows in _by_label(a):
        cols = np.flatnonzero(c.label != label)
        if not len(cols):
            continue
        s = scores(a, c, rows, cols)
        order = np.argsort(~s, axis=1, kind="stable")
        falling = ~np.take_along_axis(s, order, 1)  # ascends where scores fall
        for r, i in enumerate(rows.tolist()):
            for k, p in enumerate(a.positives[i] or ()):
                lo, hi = -((-low * p["score"]) // 100), (high * p["score"]) // 100
                if lo > hi:
                    continue
                first, last = np.searchsorted(falling[r], ~hi, "left"), np.searchsorted(falling[r], ~lo, "right")
                at = order[r, first : min(last, first + size)]
                out.append((np.full(len(at), i * slots + k), s[r, at], c.id[cols[at]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(3))


def slots_of(a: Tile) -> int:
    return max([1, *(len(p or ()) for p in a.positives)])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Tile, Tile]]:
    """Pairs of tiles; the same anchor tile, which comes in a row, is read once."""
    last = None
    for b in batches:
        for k in range(b.num_rows):
            number = b.column("a")[k].as_py()
            if last is None or last[0] != number:
                last = number, Tile(b.column("anchors"), k)
            yield number, last[1], Tile(b.column("candidates"), k)


def positives_of(pairs: DataFrame, size: int) -> DataFrame:
    """row (the anchor's), rank (from 1), score, id: the best rows of each anchor's label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = None, None
        for n, a, c in _runs(batches):
            if n != number and held is not None:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["row", "score", "id"])
                held = None
            number, held = n, merged(held, positive_heap(a, c, size), size)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["row", "score", "id"])

    heaps = pairs.mapInArrow(run, "row long, score long, id long")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "id")
    return heaps.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= size)


def negatives_of(pairs: DataFrame, size: int, low: int, high: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; anchors carry their positives."""
    names = ["row", "anchor_id", "place", "positive_id", "positive_score", "negative_score", "negative_id"]

    def shown(a: Tile, held: tuple) -> pa.RecordBatch:
        slot, score, ids = held
        slots = slots_of(a)
        i, k = slot // slots, slot % slots
        p = [a.positives[x][y] for x, y in zip(i.tolist(), k.tolist(), strict=True)]
        cols = [a.row[i], a.id[i], k, np.asarray([x["id"] for x in p], np.int64), np.asarray([x["score"] for x in p], np.int64), score, ids]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, None
        for n, a, c in _runs(batches):
            if last is not None and n != last[0] and held is not None:
                yield shown(last[1], held)
                held = None
            last, held = (n, a), merged(held, negative_heap(a, c, size, low, high), size)
        if held is not None:
            yield shown(last[1], held)

    heaps = pairs.mapInArrow(run, ", ".join(f"{n} long" for n in names))
    best = Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), "negative_id")
    return heaps.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= size).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine(df: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, anchors: int = ANCHORS, candidates: int = CANDIDATES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, from df (vec_id, embedding, label)."""
    rows = vectors(df)
    chosen = rows.filter("anchor")
    right, n_right = tiles(rows, candidates)
    right = stored(right, "candidate-tiles", "zstd")
    left, n_left = tiles(chosen, anchors)
    best = stored(positives_of(grid(left, n_left, right, n_right), positives), "positives")
    # at most `positives` rows for each anchor
    of_anchor = best.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("positives"))
    left, n_left = tiles(chosen.join(of_anchor, "row"), anchors, "positives")
    return negatives_of(grid(left, n_left, right, n_right), negatives, low, high)
