"""Line deduplication: explode normalised lines, hash, count distinct documents per hash, drop, reassemble by position.

Only hashes of long lines are shuffled to be counted, each once per document and with partial aggregation; those over the
threshold are written to the shared folder, so that the join back knows their size (broadcast when small, otherwise a
sort-merge join whose hot keys adaptive execution splits). What goes to the texts is positions, not lines.

Defined results: a null text counts as empty (one empty line); repeated rows (of one doc_id and one text) count as one
document and are treated alike; rows without a doc_id, or that share one, with different texts are documents of their own,
and of those with the largest doc_id the one with the largest hash of its text keeps the line; equal lines within the
surviving document all stay; a very long text is split and joined in one row and needs some times its size; other columns
are carried in a struct, so their names can't clash; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import keyed, stored, whole_row

MIN_CHARS = 40
MIN_DOCS = 5


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, twin, pos and a 128-bit hash (h1, h2) of each line of keyed rows whose key has min_chars code points or more."""
    rows = docs.select("doc_id", "twin", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    # a line shorter than min_chars has no longer key: most lines end here, before any work on them
    rows = rows.filter(F.length("line") >= min_chars)
    key = F.regexp_replace("line", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    rows = rows.select("doc_id", "twin", "pos", key.alias("key")).filter(F.length("key") >= min_chars)
    key = F.translate("key", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return rows.select("doc_id", "twin", "pos", key.alias("key")).select("doc_id", "twin", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, twin and the array of line positions that go, from keyed rows."""
    keys = stored(line_keys(docs, min_chars), "line-keys")
    per_doc = keys.groupBy("h1", "h2", "doc_id", "twin").agg(F.lit(1).alias("one"))
    common = per_doc.groupBy("h1", "h2").agg(F.count("one").alias("n_docs"), F.max(F.struct("doc_id", "twin")).alias("last"))
    common = stored(common.filter(F.col("n_docs") >= min_docs), "line-common")
    gone = keys.join(common, ["h1", "h2"]).filter((F.col("doc_id") != F.col("last.doc_id")) | (F.col("twin") != F.col("last.twin")))
    return gone.groupBy("doc_id", "twin").agg(F.collect_set("pos").alias("drop_at"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, drop in zip(batch.column("text").to_pylist(), batch.column("drop_at").to_pylist(), strict=True):
            lines = text.split("\n")
            gone = set(drop or ())
            kept = [x for i, x in enumerate(lines) if i not in gone] if gone else lines
            out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
        rest = [batch.column(i) for i, f in enumerate(batch.schema) if f.name not in ("text", "drop_at")]
        names = [f.name for f in batch.schema if f.name not in ("text", "drop_at")]
        yield pa.RecordBatch.from_arrays(
            [*rest, pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())],
            names=[*names, "text", "n_lines", "n_dropped"],
        )


def dedup_lines(df: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text (the kept lines joined by \\n), n_lines, n_dropped for each row of df."""
    docs = keyed(df)
    gone = dropped_lines(docs, min_chars, min_docs)
    # a merge join at every size: whether one side could be broadcast would depend on the corpus
    return docs.join(gone.hint("merge"), ["doc_id", "twin"], "left").drop("twin").mapInArrow(_cut, "doc_id long, text string, n_lines long, n_dropped long")


def dedup_table(df: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """df with the kept lines as text and their length as n_chars, if it has that column."""
    docs = keyed(df, whole_row(df))
    rows = docs.join(dropped_lines(docs, min_chars, min_docs).hint("merge"), ["doc_id", "twin"], "left").drop("twin")
    row = rows.schema["_row"].dataType.simpleString()
    out = rows.mapInArrow(_cut, f"doc_id long, _row {row}, text string, n_lines long, n_dropped long")
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(df.schema["n_chars"].dataType) if "n_chars" in df.columns else None}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"_row.`{c}`") for c in df.columns])


def digest(df: DataFrame) -> DataFrame:
    return dedup_lines(df).withColumn("kept_sha256", F.sha2("text", 256)).drop("text")
