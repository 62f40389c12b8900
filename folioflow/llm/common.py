"""What the training-data operators share: tables in the shared folder, word hashes, packed bytes."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; bounds a Python worker's memory.
SLICE_BYTES = 1 << 21


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a new local one only where the setting is absent and all runs on one machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors, gives the planner true sizes."""
    path = fresh_dir(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_limits(spark: SparkSession) -> None:
    """Small Arrow batches: a batch of long texts must fit a worker beside its numpy arrays.

    Python workers also learn where this package lies, for a session that was not started in its folder.
    """
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if top not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (top, env.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 * SLICE_BYTES))


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_limits(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def doc_id(column: str = "doc_id") -> Column:
    """The id of a row; rows without one share the id -1."""
    return F.coalesce(F.col(column).cast("long"), F.lit(-1)).alias(column)


def texts(df: DataFrame, *more: Column) -> DataFrame:
    """doc_id and text (null: empty), and no other column but those given."""
    return df.select(doc_id(), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def whole_row(df: DataFrame) -> Column:
    """All of df's columns in one struct _row, so that no other name can clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")


def carried(df: DataFrame) -> DataFrame:
    """doc_id, text and df's row as the struct _row."""
    return texts(df, whole_row(df))


def keyed(df: DataFrame, *more: Column) -> DataFrame:
    """doc_id, twin, text (null: empty) and the columns given; doc_id and twin together name a document.

    twin is 0 for a row whose doc_id has one text only. Rows that share a doc_id with different texts, and rows without
    a doc_id, have a hash of the text there, so that no row's lines or bytes are taken for another's; equal rows are one
    document.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = df.select(F.col("doc_id").cast("long").alias("_id"), text.alias("text"), *more)
    names = df.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text).alias("_h")).filter("_id IS NOT NULL")
    shared = names.groupBy("_id").agg(F.min("_h").alias("lo"), F.max("_h").alias("hi")).filter("lo <> hi").select("_id", F.lit(True).alias("_shared"))
    shared = stored(shared, "shared-ids")
    rows = rows.withColumn("_shared", F.when(F.col("_id").isNull(), F.lit(True)))
    if not shared.isEmpty():
        named = rows.filter("_id IS NOT NULL").drop("_shared").join(shared.hint("merge"), "_id", "left").select(rows.columns)
        rows = named.unionByName(rows.filter("_id IS NULL"))
    twin = F.when(F.col("_shared"), F.xxhash64("text")).otherwise(F.lit(0)).cast("long").alias("twin")
    return rows.select(F.coalesce("_id", F.lit(-1).cast("long")).alias("doc_id"), twin, "text", *[c for c in rows.columns if c not in ("_id", "text", "_shared")])


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow column of strings or bytes without nulls as one byte array and n + 1 offsets into it."""
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about size bytes of text (a longer text makes a piece of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = string_bytes(batch.column("text"))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


_MUL = 0x9E3779B97F4A7C15


#: The powers that a worker keeps: one pair of arrays, from which shorter ones are cut.
_kept: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    out = []
    for m in (_MUL, pow(_MUL, -1, 1 << 64)):
        x = np.full(n, m, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, n of each at least; kept for the next call unless they are many."""
    global _kept
    size = 1 << max(16, n.bit_length())
    found = _kept if _kept and len(_kept[0]) >= size else _powers(size)
    if found is not _kept and size <= 1 << 22:
        _kept = found
    return found[0][:size], found[1][:size]


class Names:
    """Names of any byte ranges of data, from prefix sums."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = powers(len(data))
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[: len(data)], out=self.prefix[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mixed((self.prefix[hi] - self.prefix[lo]) * self.inverse[lo])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.prefix) - k
        return mixed((self.prefix[k:] - self.prefix[:n]) * self.inverse[:n])


def word_hashes(data: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of all texts, in order, and how many each text has."""
    n = len(at) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    bounds = at[:-1][(at[:-1] > 0) & (at[:-1] < len(data))]  # a text's first byte starts a word, the one before ends one
    first[bounds], last[bounds - 1] = inside[bounds], inside[bounds - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    hashes = mixed(Names(data).of(starts, ends) ^ (ends - starts).astype(np.uint64))
    counts = np.diff(np.searchsorted(starts, at))
    return hashes, counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingle hashes of each text, sorted within a text, and the number of each text.

    A text of 1 to k - 1 words has its whole sequence as one shingle; a text without words has none.
    """
    ends = np.cumsum(counts)
    begins = ends - counts
    if not len(words):
        return words, np.zeros(len(counts), np.int64)
    h = np.zeros(len(words), np.uint64)
    for i in range(k):  # h[p]: hash of the words p .. p + k - 1; made valid below by the mask
        h[: len(words) - i] = mixed(h[: len(words) - i] * np.uint64(0xD6E8FEB86659FD93) + words[i:])
    doc = np.repeat(np.arange(len(counts)), counts)
    keep = np.arange(len(words)) + k <= ends[doc]
    short = (counts > 0) & (counts < k)
    for d in np.flatnonzero(short):
        x = np.zeros(1, np.uint64)
        for w in words[begins[d] : ends[d]]:
            x = mixed(x * np.uint64(0xD6E8FEB86659FD93) + w)
        h[begins[d]] = mixed(x + np.uint64(counts[d]))[0]
        keep[begins[d]] = True
    h, doc = h[keep], doc[keep]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=len(counts))


def packed_sorted(values: np.ndarray) -> bytes:
    """Sorted unsigned numbers as zstd-compressed byte planes of their differences."""
    import zstandard

    values = values.astype(np.uint64)
    gaps = np.diff(values, prepend=np.uint64(0))
    planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked_sorted(blob: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def local_path(uri: str) -> str | None:
    """The path of a file: folder that all executors see, else None."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def open_fs(uri: str):
    """A pyarrow file system and the path in it, for any scheme that pyarrow knows."""
    from pyarrow import fs

    if path := local_path(uri):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, *data: bytes | Iterator[bytes]) -> None:
    """Whole or not at all, so that a repeated task attempt leaves the same file. data: bytes, or iterators of them."""
    files, path = open_fs(uri)
    files.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(part) as out:
        for x in data:
            for piece in [x] if isinstance(x, bytes) else x:
                out.write(piece)
    files.move(part, path)


def open_file(uri: str):
    """A stream of the file's bytes."""
    files, path = open_fs(uri)
    return files.open_input_stream(path)


def read_file(uri: str) -> bytes:
    with open_file(uri) as f:
        return f.read()
