"""Best-fit packing with large-item matching.

Texts become token ids with an end id; a longer one is cut into full pieces and a rest. The plan works on the histogram of
piece lengths, which has at most `capacity` entries however many documents there are, and is all that the driver sees: pieces above a third of the capacity
are matched, the longest first, each with the longest large piece that still fits (at most two large ones in a sequence);
then smaller lengths, the longest first, go to the tightest gap that holds them, or open new sequences. All sequences with
the same gap are interchangeable, so each step moves whole ranges of them. A plan row says: of the pieces of this length,
those ranked lo .. lo + n - 1 go to sequences first .. first + n - 1 at this offset. Pieces find their row by their rank
among those of their length; ranks come from counts by (length, salt), with as many salts as shuffle partitions, so that no
task holds all pieces of one length.

Defined results: a null or empty text is a piece with the end id alone; repeated rows, and rows without a doc_id (-1), are
packed each on their own, equal ones in any order; a very long text is encoded as a whole and leaves in pieces; of lengths
that fit equally well the longest is taken; other columns are not looked at; an empty table gives an empty plan.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioflow.llm.coding import word_ids
from folioflow.llm.common import SLICE_BYTES, partitions, slices, stored, texts

CAPACITY = 4096
#: Bytes of text whose runs are in a worker's memory at once (no effect on results).
READ_BYTES = SLICE_BYTES // 2


def pieces(df: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian unsigned 32 bit) of each piece of each row of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end, step = word_ids(vocabulary), np.asarray([end_id], "<u4").tobytes(), 4 * capacity
        for b in slices(batches, READ_BYTES):
            doc, piece, start, length, crc, kept = [], [], [], [], [], []
            for d, ids in zip(b.column("doc_id").to_pylist(), coder.ids(b.column("text").to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    doc.append(d)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        kept.append(part)
            cols = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.binary())] * keep_ids, names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids)

    return texts(df).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, lo, n, first, offset) from the number of pieces of each length."""
    left = {n: c for n, c in counts.items() if c}
    given = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, deque] = {}
    free = 0  # bit g: there are sequences with gap g
    bins = 0

    def place(size: int, n: int, first: int, offset: int) -> None:
        rows.append((size, given[size], n, first, offset))
        given[size] += n
        left[size] -= n

    def put(gap: int, first: int, n: int) -> None:
        nonlocal free
        if gap:
            gaps.setdefault(gap, deque()).append((first, n))
            free |= 1 << gap

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for size in large:
        for other in large:
            if not left[size]:
                break
            if other > size or size + other > capacity or not left[other]:
                continue
            n = left[size] // 2 if other == size else min(left[size], left[other])
            if n:
                place(size, n, bins, 0)
                place(other, n, bins, size)
                put(capacity - size - other, bins, n)
                bins += n
        if n := left[size]:
            place(size, n, bins, 0)
            put(capacity - size, bins, n)
            bins += n
    for size in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[size] and (fits := free >> size):
            gap = size + (fits & -fits).bit_length() - 1
            first, n = gaps[gap].popleft()
            if n > left[size]:
                gaps[gap].appendleft((first + left[size], n - left[size]))
                n = left[size]
            if not gaps[gap]:
                free &= ~(1 << gap)
            place(size, n, first, capacity - gap)
            put(gap - size, first, n)
        each = capacity // size
        if whole := left[size] // each:
            for k in range(each):
                place(size, whole, bins, k * size)
            put(capacity - each * size, bins, whole)
            bins += whole
        if rest := left[size]:
            for k in range(rest):
                place(size, 1, bins, k * size)
            put(capacity - rest * size, bins, 1)
            bins += 1
    return np.asarray(rows, np.int64).reshape(-1, 5)


def pack_pieces(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """found (doc_id, piece, start, length, ids_crc32 and more columns) with sequence_id and offset; found should be a stored table."""
    salts = partitions(found.sparkSession)
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "start"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_size"))
    totals = sizes.groupBy("length").agg(F.sum("_size").alias("n")).collect()  # at most `capacity` rows, whatever the input
    rows = plan({r.length: r.n for r in totals}, capacity)
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    rows = rows[order]
    starts = (rows[:, 0] << 44) + rows[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            at = np.searchsorted(starts, (length << 44) + rank, "right") - 1
            row = rows[at]
            names = [n for n in b.schema.names if n != "_rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])], names=[*names, "sequence_id", "offset"])

    # a length has at most one row for each salt
    before = sizes.withColumn("_before", F.sum("_size").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_size")).drop("_size")
    ranked = salted.withColumn("_n", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")))
    ranked = ranked.join(before.hint("merge"), ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_n") - 1).drop("_salt", "_before", "_n")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "_rank")
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack(df: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    out = pack_pieces(stored(pieces(df, vocabulary, end_id, capacity, keep_ids), "pieces"), capacity)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * keep_ids)
