"""Joins with fallbacks, existence tests, write modes (upsert, insert if absent, part replacement) and their counters."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def resolved_parent(tables: DataFrame, nodes: DataFrame, exact: Column, wider: Column) -> DataFrame:
    """tables with parent_id: the node of id `exact`, else that of `wider`, else null."""
    ids = nodes.select("id").distinct()
    a, b = ids.withColumnRenamed("id", "_a"), ids.withColumnRenamed("id", "_b")
    rows = tables.withColumns({"_x": exact, "_y": wider})
    return rows.join(a, F.col("_x") == F.col("_a"), "left").join(b, F.col("_y") == F.col("_b"), "left").select(*[c for c in tables.columns if c != "parent_id"], F.coalesce("_a", "_b").alias("parent_id"))


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All keys; a new row replaces the old one. Nothing is deleted."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Column by column: the new value where it is not null, with the action taken."""
    o, n = old.alias("o"), new.alias("n")
    action = F.when(F.col(f"o.{key}").isNull(), "insert").when(F.col(f"n.{key}").isNull(), "keep").otherwise("update")
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(*[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in old.columns], action.alias("action"))


def inserted_if_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.dropDuplicates([key]).join(old.select(key), key, "left_anti"))


def part_replaced(old: DataFrame, new: DataFrame, part: str) -> DataFrame:
    """Rows of the parts that new brings are replaced as wholes."""
    return old.join(new.select(part).distinct(), part, "left_anti").unionByName(new)


def null_parent_fallback(rows: DataFrame, parents: DataFrame, key: str, id_: str) -> DataFrame:
    """A key that names no row becomes null."""
    p = parents.select(F.col(id_).alias("_p"))
    return rows.join(p, F.col(key) == F.col("_p"), "left").withColumn(key, F.col("_p")).drop("_p")


def best_by(rows: DataFrame, key: str, value: str, by: str) -> DataFrame:
    """For each key the value with the highest `by` (ties: the smallest value)."""
    return rows.groupBy(key).agg(F.min_by(value, F.struct(-F.col(by), F.col(value))).alias(value), F.max(by).alias(by))


def zipped(left: DataFrame, right: DataFrame, place: str, left_id: str, right_id: str) -> DataFrame:
    """place, k, left_id, right_id: the k-th of both sides at each place, in the order of their ids; the longer side's rest goes."""
    numbered = lambda rows, id_: rows.select(place, id_, F.row_number().over(Window.partitionBy(place).orderBy(id_)).cast("long").alias("k"))
    return numbered(left, left_id).join(numbered(right, right_id), [place, "k"])


def overridden(tables: DataFrame, overrides: DataFrame) -> DataFrame:
    """tables (id, title, html, source) with overrides (id, patch, html): added to the html that is there if patch, else in
    its place. A patch of a table without html has no effect."""
    o = overrides.select("id", "patch", F.col("html").alias("_new"))
    there = F.col("_new").isNotNull() & (~F.col("patch") | F.col("html").isNotNull())
    html = F.when(there & F.col("patch"), F.concat("html", "_new")).when(there, F.col("_new")).otherwise(F.col("html"))
    return tables.join(o, "id", "left").select("id", "title", html.alias("html"), F.when(there, "manual_override").otherwise(F.col("source")).alias("source"))


def selected(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key is wanted, once each."""
    return rows.join(wanted.select(key).distinct(), key, "left_semi")


def nearest_below(titles: DataFrame, grids: DataFrame, page: str, title: str, grid: str, y: str = "y", within: float = 200.0) -> DataFrame:
    """Page, title, grid: from the top of a page down, each title takes the nearest free grid at or below it, less than
    `within` away.

    Titles that wait stand in a queue: the next grid goes to the first of them that it is near enough to, and those that it
    is too far from have none. So one sorted pass over a page decides, and no title meets all grids. Equal heights: titles
    first, then by id. A task holds the titles of at most `within` of a page.
    """
    both = titles.select(F.col(page).alias("page"), F.col(y).cast("double").alias("y"), F.lit(0).alias("kind"), F.col(title).cast("string").alias("id"))
    both = both.unionByName(grids.select(F.col(page).alias("page"), F.col(y).cast("double").alias("y"), F.lit(1).alias("kind"), F.col(grid).cast("string").alias("id")))
    order = ["page", "y", "kind", "id"]
    kind = both.schema["page"].dataType

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting = None, deque()
        for b in batches:
            out = []
            for p, top, k, i in zip(*(b.column(n).to_pylist() for n in order), strict=True):
                if p != at:
                    at, waiting = p, deque()
                while waiting and top - waiting[0][0] >= within:
                    waiting.popleft()
                if not k:
                    waiting.append((top, i))
                elif waiting:
                    out.append((p, waiting.popleft()[1], i))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], b.schema.field("page").type), *(pa.array([x[c] for x in out], pa.string()) for c in (1, 2))], names=["page", "title", "grid"])

    rows = both.filter("y IS NOT NULL").repartition("page").sortWithinPartitions(*order)
    return rows.mapInArrow(matched, f"page {kind.simpleString()}, title string, grid string")
