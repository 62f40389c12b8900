"""Operators on ordered rows: fill-down, gaps, runs, islands, continuations, recency, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioflow.functions.text import bound


def blank_to_null(cell: Column) -> Column:
    return F.when(F.trim(cell) != "", cell)


def fill_down(cells: DataFrame) -> DataFrame:
    w = Window.partitionBy("table_id", "col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    return cells.select("table_id", "row", "col", F.last(blank_to_null(F.col("cell")), ignorenulls=True).over(w).alias("cell"))


def gaps(rows: DataFrame, key: str, number: str) -> DataFrame:
    """key, after, before, missing: where the next distinct number skips some; missing holds them, comma-joined."""
    w = Window.partitionBy(key).orderBy(number)
    pairs = rows.select(key, number).distinct().select(key, F.col(number).alias("after"), F.lead(number).over(w).alias("before"))
    return pairs.filter("before > after + 1").withColumn("missing", F.array_join(F.transform(F.sequence(F.col("after") + 1, F.col("before") - 1), lambda x: x.cast("string")), ","))


def order_violations(rows: DataFrame, key: str, order: list[str], number: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return rows.select(key, *order, number, F.lag(number).over(w).alias("before")).filter(F.col("before") > F.col(number))


def first_gap(numbers: Column, most: int = 2) -> Column:
    """The first neighbouring pair of distinct numbers, in order of appearance, that lie more than `most` apart: a_to_b."""

    def named(seen: Column) -> Column:
        wide = F.filter(F.transform(seen, lambda b, i: F.struct(F.get(seen, i - 1).alias("a"), b.alias("b"))), lambda p: p["b"] - p["a"] > most)
        return bound(F.get(wide, F.lit(0)), lambda p: F.concat(p["a"].cast("string"), F.lit("_to_"), p["b"].cast("string")))

    return bound(F.array_distinct(numbers), named)


def _with_row_spans(cells: DataFrame) -> DataFrame:
    w = Window.partitionBy("table_id", "col").orderBy("row")
    same = (F.col("v") != "") & (F.col("v") == F.lag("v").over(w))
    runs = cells.withColumn("v", F.trim(F.coalesce("cell", F.lit("")))).withColumn("new", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    run = Window.partitionBy("table_id", "col", "run")
    return runs.select(*cells.columns, F.when(F.col("new") == 1, F.count("*").over(run)).otherwise(0).alias("rowspan"))


def _with_column_spans(cells: DataFrame) -> DataFrame:
    w = Window.partitionBy("table_id", "row").orderBy("col")
    runs = cells.withColumn("run", F.sum(F.when(F.col("cell").isNotNull(), 1).otherwise(0)).over(w))
    run = Window.partitionBy("table_id", "row", "run")
    return runs.select(*cells.columns, F.when(F.col("cell").isNotNull(), F.count("*").over(run)).otherwise(0).alias("colspan"))


def row_spans(cells: DataFrame) -> DataFrame:
    """table_id, row, col, rowspan: length of a run of equal cells at its first row, 0 below; blank cells stand alone."""
    return _with_row_spans(cells.select("table_id", "row", "col", "cell")).drop("cell")


def column_spans(cells: DataFrame) -> DataFrame:
    """table_id, row, col, colspan: a cell and the nulls to its right; nulls are hidden (0), at the left end too."""
    return _with_column_spans(cells.select("table_id", "row", "col", "cell")).drop("cell")


def spans(cells: DataFrame) -> DataFrame:
    """table_id, row, col, cell, rowspan, colspan of cells that each have a place of their own; those without one are left out.

    Cells are read once and no relation is joined back to them; cells that are dealt by table stay where they are.
    """
    placed = _with_column_spans(_with_row_spans(cells.select("table_id", "row", "col", "cell")))
    return placed.filter("table_id IS NOT NULL AND row IS NOT NULL AND col IS NOT NULL")


def continuations(parts: DataFrame) -> DataFrame:
    """Tables that go on over pages: parts (owner, page, idx, table_id, rows) with the same id at most one page on are one."""
    w = Window.partitionBy("owner").orderBy("page", "idx")
    goes_on = F.col("table_id").isNotNull() & (F.lag("table_id").over(w) == F.col("table_id")) & (F.col("page") - F.lag("page").over(w) <= 1)
    runs = parts.withColumn("run", F.sum(F.when(goes_on, 0).otherwise(1)).over(w))
    return runs.groupBy("owner", "run").agg(F.first("table_id").alias("table_id"), F.min("page").alias("page"), F.max("page").alias("end_page"), F.count("*").alias("parts"), F.sum("rows").alias("rows"))


def assembled(lines: DataFrame, type_: Column, number: Column) -> DataFrame:
    """Clauses put together over lines and pages: doc, n, page (where it closes), content.

    A clause starts a block, any heading closes it, other lines append; lines of a notes region belong to none.
    """
    w = Window.partitionBy("doc").orderBy("page", "line", "text")
    heading = ~F.coalesce(F.col("type"), F.lit("")).isin("clause", "subclause", "subsubclause", "")
    notes = F.last(F.when(F.col("text").startswith("Notes to Table"), 1).when(heading | (F.col("type") == "clause"), 0), ignorenulls=True).over(w)
    rows = lines.withColumn("type", type_).withColumn("n", number).withColumn("_notes", F.coalesce(notes, F.lit(0))).filter("_notes = 0")
    starts = F.when(F.col("type").isNotNull() & ~F.col("type").isin("subclause", "subsubclause"), 1).otherwise(0)
    # rows before the first start have no kind; a block's kind is its start's type
    rows = rows.withColumns({"block": F.sum(starts).over(w), "kind": F.last(F.when(starts == 1, F.col("type")), ignorenulls=True).over(w)})
    texts = F.transform(F.array_sort(F.collect_list(F.struct("page", "line", "text"))), lambda x: x["text"])
    return rows.filter("kind = 'clause'").groupBy("doc", "block").agg(F.max("n").alias("n"), F.max("page").alias("page"), F.array_join(texts, " ").alias("content")).drop("block")


def most_recent(visits: DataFrame, user: str, item: str, at: str, keep: int = 8) -> DataFrame:
    """The last visit of each item, newest first, at most `keep` a user."""
    last = visits.groupBy(user, item).agg(F.max(at).alias("last_at"))
    w = Window.partitionBy(user).orderBy(F.desc("last_at"), item)
    return last.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)


def first_of(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_rn = 1").drop("_rn")


def duplicate_suspects(docs: DataFrame, at_least: int = 200, head: int = 100) -> DataFrame:
    """id, first_id: rows longer than at_least that share length and first characters with an earlier one."""
    rows = docs.filter(F.length("content") > at_least).select("id", F.length("content").alias("n"), F.substring("content", 1, head).alias("head"))
    first = F.min("id").over(Window.partitionBy("n", "head"))
    return rows.select("id", first.alias("first_id")).filter("id > first_id")


def nearest(rows: DataFrame, key: str, id_: str, top: str) -> DataFrame:
    """The item at or below the top edge that is nearest to it, else the nearest at all."""
    below = F.expr(f"min_by({id_}, struct({top}, {id_})) FILTER (WHERE {top} >= 0)")
    return rows.groupBy(key).agg(F.coalesce(below, F.expr(f"min_by({id_}, struct(abs({top}), {id_}))")).alias("nearest"))


def last_seen(rows: DataFrame, group: str, block: str, order: list[str], values: dict[str, Column]) -> DataFrame:
    """rows and, for each of values, the last one that isn't null at or before the row in its group.

    block grows with the order within a group and bounds what one task sorts: each block is scanned alone, and the last
    values of the blocks before it come from one row a block. A group may be as long as it likes; null groups are one.
    Where rows say that their group is one block (last_block: 0), nothing comes from before, and they are read once.
    """
    if "last_block" in rows.columns:
        alone, long = rows.filter("last_block = 0"), rows.filter("last_block > 0").drop("last_block")
        w = Window.partitionBy(group).orderBy(*order)
        alone = alone.drop("last_block").withColumns(values).select(*long.columns, *[F.last(n, ignorenulls=True).over(w).alias(n) for n in values])
        return alone.unionByName(last_seen(long, group, block, order, values))
    named = rows.withColumns(values)
    here, up = Window.partitionBy(group, block).orderBy(*order), Window.partitionBy(group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    ends = named.groupBy(group, block).agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.struct(*order))).alias(n) for n in values])
    before = ends.select(F.col(group).alias("_group"), F.col(block).alias("_block"), *[F.last(n, ignorenulls=True).over(up).alias(f"_before_{n}") for n in values])
    found = named.join(before, F.col(group).eqNullSafe(F.col("_group")) & F.col(block).eqNullSafe(F.col("_block")))
    return found.select(*rows.columns, *[F.coalesce(F.last(n, ignorenulls=True).over(here), F.col(f"_before_{n}")).alias(n) for n in values])
