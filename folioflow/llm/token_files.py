"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Ids are replaced by their rank by corpus frequency, so that the commonest 256 take one byte. A rank takes 1 to 4 bytes,
little-endian; a control byte holds the lengths less one of four ranks in 2 bits each, the first in the lowest. A file is
a row of blocks; a block ends with the document that brings it to BLOCK ids or more:

    b"FVB1", documents u32, ids u64, data bytes u64, doc ids i64[], lengths u64[], control bytes, data bytes

Each task writes one file of an ascending range of doc ids, under a name that its partition gives, whole or not at all: a
repeated attempt writes the same file. The driver sees one row for each file and, for the ranks, one for each id of the
vocabulary. Writing and reading hold a block at a time; reading decodes it by a table of the 256 control bytes. Defined
results: null counts as empty (the end id alone); rows of one doc_id, equal or not, follow each other in the order of a hash
of their ids, those without a doc_id as -1, and may lie in several files; a very long text is one block of its own; other columns are not looked at; an empty
table writes no file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.coding import byte_ids
from folioflow.llm.common import fresh_dir, open_file, partitions, stored, texts, write_file
from folioflow.llm.token_counts import tokenizer

MAGIC = b"FVB1"
BLOCK = 1 << 20
_HEAD = "<4sIQQ"
_HEAD_SIZE = struct.calcsize(_HEAD)
_CONTROL = np.arange(256, dtype=np.uint8)
#: Lengths of the four ranks of each control byte.
_LENGTHS = np.stack([(_CONTROL >> (2 * k)) & 3 for k in range(4)], 1).astype(np.int64) + 1


def encode_block(docs: np.ndarray, lengths: np.ndarray, ranks: np.ndarray) -> bytes:
    """One block of documents; ranks: those of all documents, in order."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = size - 1
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    head = struct.pack(_HEAD, MAGIC, len(docs), len(ranks), len(data))
    return head + docs.astype("<i8").tobytes() + lengths.astype("<u8").tobytes() + control.astype(np.uint8).tobytes() + data.tobytes()


def rest_of_block(head: bytes) -> int:
    """The bytes of a block after its head."""
    _, n_docs, n, n_data = struct.unpack(_HEAD, head)
    return 16 * n_docs + -(-n // 4) + n_data


def decode_block(blob: memoryview | bytes, at: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """doc ids, lengths and ranks of the block at a place, and the place after it."""
    magic, n_docs, n, n_data = struct.unpack_from(_HEAD, blob, at)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    at += _HEAD_SIZE
    docs = np.frombuffer(blob, "<i8", n_docs, at)
    lengths = np.frombuffer(blob, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
    at += 16 * n_docs
    control = np.frombuffer(blob, np.uint8, -(-n // 4), at)
    at += len(control)
    data = np.frombuffer(blob, np.uint8, n_data, at)
    size = _LENGTHS[control].ravel()[:n]
    place = np.cumsum(size) - size
    ranks = data[place].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        ranks[more] |= data[place[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return docs, lengths, ranks, at + n_data


def _kind(vocabulary: str) -> str:
    """Two bytes for an id where the vocabulary allows, else four."""
    return "<u2" if tokenizer(vocabulary).get_vocab_size() <= 1 << 16 else "<u4"


def coded(df: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """doc_id and ids (with the end id, as _kind(vocabulary) says) of each row of df."""
    kind = _kind(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = byte_ids(vocabulary), np.asarray([end_id], "<u4").tobytes()
        for b in batches:
            ids = [np.frombuffer(x + end, "<u4").astype(kind).tobytes() for x in coder.ids(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return texts(df).mapInArrow(run, "doc_id long, ids binary")


def ranking(ids: DataFrame, kind: str) -> np.ndarray:
    """The ids of the corpus by falling frequency (ties: by id); at most one entry for each id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            seen = np.bincount(np.frombuffer(b"".join(b.column("ids").to_pylist()), kind), minlength=len(total))
            seen[: len(total)] += total
            total = seen
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    found = ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    return found.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(np.uint32)


def write_files(ids: DataFrame, kind: str, by_rank: np.ndarray, folder: str, block: int = BLOCK) -> list[dict]:
    """Writes doc_id, ids in ascending doc_id order; a dict for each file, in order, with the ids before it as start."""
    rank = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [0, 0]

        def blocks() -> Iterator[bytes]:
            docs, parts, held = [], [], 0
            for b in batches:
                for d, x in zip(b.column("doc_id").to_pylist(), b.column("ids"), strict=True):
                    docs.append(d)
                    parts.append(rank[np.frombuffer(x.as_buffer(), kind)])
                    held += len(parts[-1])
                    if held >= block:
                        yield closed(docs, parts)
                        docs, parts, held = [], [], 0
            if docs:
                yield closed(docs, parts)

        def closed(docs: list[int], parts: list[np.ndarray]) -> bytes:
            lengths = np.asarray([len(x) for x in parts], np.int64)
            counts[0] += len(docs)
            counts[1] += int(lengths.sum())
            return encode_block(np.asarray(docs, np.int64), lengths, np.concatenate(parts))

        rest = blocks()
        first = next(rest, None)
        if first:
            part = TaskContext.get().partitionId()
            uri = f"{folder}/part-{part:06d}.fvb"
            write_file(uri, first, rest)
            yield pa.RecordBatch.from_pydict({"part": [part], "uri": [uri], "n_docs": [counts[0]], "n_ids": [counts[1]]})

    # a hash and a number beside the id: rows that share an id, or have none, fall into many files
    order = ["doc_id", "_hash", "_n"]
    numbered = ids.select("doc_id", "ids", F.xxhash64("ids").alias("_hash"), F.monotonically_increasing_id().alias("_n"))
    sorted_ids = numbered.repartitionByRange(partitions(ids.sparkSession), *order).sortWithinPartitions(*order)
    files = sorted_ids.select("doc_id", "ids").mapInArrow(run, "part long, uri string, n_docs long, n_ids long").collect()
    out, start = [], 0
    for f in sorted(files, key=lambda f: f["part"]):
        out.append(f.asDict() | {"start": start})
        start += f["n_ids"]
    return out


def read_files(spark: SparkSession, files: list[dict], by_rank: np.ndarray, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of each document, decoded from the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start in zip(b.column("uri").to_pylist(), b.column("start").to_pylist(), strict=True):
                with open_file(uri) as f:
                    while head := f.read(_HEAD_SIZE):
                        docs, lengths, ranks, _ = decode_block(head + f.read(rest_of_block(head)))
                        ids = by_rank[ranks].astype("<u4")
                        ends = np.cumsum(lengths)
                        parts = [ids[e - n : e].tobytes() for e, n in zip(ends, lengths, strict=True)]
                        cols = [pa.array(docs), pa.array(start + ends - lengths), pa.array(lengths), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                        yield pa.RecordBatch.from_arrays(cols + [pa.array(parts, pa.binary())] * keep_ids, names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * keep_ids)
                        start += int(lengths.sum())

    if not files:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame([(f["part"], f["uri"], f["start"]) for f in files], "part long, uri string, start long")
    return listed.repartitionByRange(len(files), "part").mapInArrow(run, schema)


def round_trip(df: DataFrame, vocabulary: str, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """Writes df's texts as files in the shared folder and reads them back."""
    ids = stored(coded(df, vocabulary, end_id), "token-ids", "zstd")
    by_rank = ranking(ids, _kind(vocabulary))
    files = write_files(ids, _kind(vocabulary), by_rank, fresh_dir(df.sparkSession, "token-files"))
    return read_files(df.sparkSession, files, by_rank, keep_ids)
