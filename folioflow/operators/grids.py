"""Operators on table grids in long form (table_id, row, col, cell): header detection, scores, comparison, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioflow.functions.text import compared, html_escaped, quotes_escaped
from folioflow.operators.ordered import blank_to_null


def numeric(cell: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(cell, F.lit("")), "[.,\\s]", "")
    return bare.rlike("^[0-9]+$") | F.trim(cell).isin("1", "2", "—", "-", "N/A")


def header_rows(cells: DataFrame) -> DataFrame:
    """table_id, header_rows: rows before the first of the first five whose filled cells are over 40 % numeric; at least 1."""
    filled = F.trim(F.coalesce("cell", F.lit(""))) != ""
    rows = cells.groupBy("table_id", "row").agg(F.count_if(filled).alias("n"), F.count_if(filled & numeric(F.col("cell"))).alias("k"))
    data = (F.col("n") > 0) & (F.col("k") * 10 > F.col("n") * 4) & (F.col("row") <= 5)
    out = rows.groupBy("table_id").agg(F.count("*").alias("rows"), F.min(F.when(data, F.col("row"))).alias("first"))
    none = F.greatest(F.lit(1), F.least(F.lit(5), F.col("rows") - 1))
    return out.select("table_id", F.when(F.col("rows") == 1, F.lit(1)).otherwise(F.coalesce(F.greatest(F.lit(1), F.col("first") - 1), none)).cast("long").alias("header_rows"))


def blank_percent(cells: DataFrame) -> DataFrame:
    blank = F.when(F.trim(F.coalesce("cell", F.lit(""))) == "", 100.0).otherwise(0.0)
    return cells.groupBy("table_id").agg(F.round(F.avg(blank), 1).alias("blank_percent"))


def compared_cells(found: DataFrame, truth: DataFrame) -> DataFrame:
    """table_id, accuracy over the shared rows and columns: 1 for equal cells, 0.5 for one within the other."""
    a = found.select("table_id", "row", "col", compared(F.coalesce("cell", F.lit(""))).alias("a"))
    b = truth.select("table_id", "row", "col", compared(F.coalesce("cell", F.lit(""))).alias("b"))
    score = F.when(F.col("a") == F.col("b"), 1.0).when(F.col("a").contains(F.col("b")) | F.col("b").contains(F.col("a")), 0.5).otherwise(0.0)
    return a.join(b, ["table_id", "row", "col"]).groupBy("table_id").agg(F.round(F.sum(score) / F.count("*"), 6).alias("accuracy"))


def shapes(cells: DataFrame) -> DataFrame:
    return cells.groupBy("table_id").agg(F.max("row").alias("rows"), F.max("col").alias("cols"))


def structure_score(found: DataFrame, expected: DataFrame) -> DataFrame:
    """table_id, score: 0.3 row ratio + 0.3 column ratio + 0.4 content ratio; found (table_id, rows, cols, content)."""
    ratio = lambda x, y: F.least(x, y) / F.greatest(x, y, F.lit(1))
    e = expected.select("table_id", F.col("rows").alias("_r"), F.col("cols").alias("_c"))
    return found.join(e, "table_id").select("table_id", F.round(0.3 * ratio(F.col("rows"), F.col("_r")) + 0.3 * ratio(F.col("cols"), F.col("_c")) + 0.4 * F.col("content"), 6).alias("score"))


def quality_score(rows: Column, cols: Column, want_rows: Column, want_cols: Column, blank_percent: Column) -> Column:
    """20 less 5 for each row amiss, 20 less 5 for each column, 60 less the blank percentage; no part below 0."""
    part = lambda most, less: F.greatest(F.lit(0.0), F.lit(most) - less)
    return F.round(part(20.0, 5 * F.abs(rows - want_rows)) + part(20.0, 5 * F.abs(cols - want_cols)) + part(60.0, blank_percent), 6)


def html_tables(cells: DataFrame) -> DataFrame:
    """table_id, html: the first row and the first column as th."""
    tag = F.when((F.col("row") == 1) | (F.col("col") == 1), "th").otherwise("td")
    cell = F.concat(F.lit("<"), tag, F.lit(">"), html_escaped(F.trim(F.coalesce("cell", F.lit("")))), F.lit("</"), tag, F.lit(">"))
    ordered = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, "t"))), lambda x: x["t"]), "")
    rows = cells.select("table_id", "row", "col", cell.alias("t")).groupBy("table_id", "row").agg(ordered("col").alias("t"))
    rows = rows.withColumn("t", F.concat(F.lit("<tr>"), "t", F.lit("</tr>")))
    return rows.groupBy("table_id").agg(ordered("row").alias("t")).select("table_id", F.concat(F.lit("<table>"), "t", F.lit("</table>")).alias("html"))


def pipe_rows(lines: DataFrame) -> DataFrame:
    """doc, line, cells (joined by ;) of markdown table rows, without separator rows."""
    rows = lines.filter(F.trim("text").startswith("|") & ~F.col("text").rlike(r"^\s*\|[\s|:-]+$"))
    parts = F.split("text", r"\|", -1)
    return rows.select("doc", "line", F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts) - 2), lambda x: F.trim(x)), ";").alias("cells"))


def pipe_blocks(lines: DataFrame, least: int = 1) -> DataFrame:
    """doc, first_line, n: runs of table rows that follow each other."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("doc").orderBy("page", "line", "text")
    is_row = F.trim("text").startswith("|")
    runs = lines.withColumn("pos", F.row_number().over(w)).filter(is_row)
    runs = runs.withColumn("run", F.col("pos") - F.row_number().over(w))
    return runs.groupBy("doc", "run").agg(F.min("line").alias("first_line"), F.count("*").alias("n")).filter(F.col("n") >= least).drop("run")


def validated(cells: DataFrame, longest: int = 500) -> DataFrame:
    """table_id, empty_columns, long_cells."""
    cols = cells.groupBy("table_id", "col").agg(F.count_if(F.trim(F.coalesce("cell", F.lit(""))) != "").alias("filled"), F.count_if(F.length("cell") > longest).alias("long"))
    return cols.groupBy("table_id").agg(F.count_if(F.col("filled") == 0).alias("empty_columns"), F.sum("long").alias("long_cells"))


def distinct_rows(cells: DataFrame) -> DataFrame:
    """table_id, rows: how many different rows a grid has."""
    row = F.transform(F.array_sort(F.collect_list(F.struct("col", F.coalesce("cell", F.lit("")).alias("c")))), lambda x: x["c"])
    return cells.groupBy("table_id", "row").agg(F.to_json(row).alias("j")).groupBy("table_id").agg(F.countDistinct("j").alias("rows"))


def grid_texts(cells: DataFrame) -> DataFrame:
    """table_id, text: the filled cells in lower case, in order, one space between."""
    filled = cells.filter(F.trim(F.coalesce("cell", F.lit(""))) != "")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("row", "col", F.lower(F.trim("cell")).alias("c")))), lambda x: x["c"])
    return filled.groupBy("table_id").agg(F.array_join(ordered, " ").alias("text"))


def keyword_scores(cells: DataFrame, keywords: list[str], invalid: list[str]) -> DataFrame:
    """table_id, score (the share of the keywords that the grid holds, 0 without any), valid (it holds none of the others)."""
    held = sum((F.when(F.col("text").contains(k.lower()), 1).otherwise(0) for k in keywords), F.lit(0))
    bad = F.lit(False)
    for k in invalid:
        bad = bad | F.col("text").contains(k.lower())
    return grid_texts(cells).select("table_id", F.round(held / max(1, len(keywords)), 6).alias("score"), (~bad).alias("valid"))


def fill_rates(cells: DataFrame) -> DataFrame:
    filled = F.when(F.trim(F.coalesce("cell", F.lit(""))) != "", 1.0).otherwise(0.0)
    return cells.groupBy("table_id").agg(F.avg(filled).alias("fill_rate"))


def grid_issues(cells: DataFrame, most_blank: float = 0.5) -> DataFrame:
    """table_id, issue: rows of different width, or more than `most_blank` of the cells null or empty."""
    rows = cells.groupBy("table_id", "row").agg(F.count("*").alias("width"), F.count_if(F.coalesce("cell", F.lit("")) == "").alias("blank"))
    tables = rows.groupBy("table_id").agg(F.min("width").alias("a"), F.max("width").alias("b"), F.sum("width").alias("n"), F.sum("blank").alias("k"))
    issues = F.array_compact(F.array(F.when(F.col("a") != F.col("b"), "RAGGED"), F.when(F.col("k") > most_blank * F.col("n"), "BLANK")))
    return tables.select("table_id", F.explode(issues).alias("issue"))


def first_ids(lines: DataFrame, pattern: str) -> DataFrame:
    """page, id: the first match of the pattern's first group on a page, which all grids of the page get."""
    found = lines.select("page", "doc", "line", "text", F.regexp_extract("text", pattern, 1).alias("id")).filter("id <> ''")
    return found.groupBy("page").agg(F.min(F.struct("doc", "line", "text", "id")).alias("x")).select("page", "x.id")


def spanned_html(cells: DataFrame, header: DataFrame) -> DataFrame:
    """table_id, html of cells (table_id, row, col, cell, rowspan, colspan) and header rows (table_id, header_rows).

    A cell that a span hides (span 0) and a null one are left out; header rows are th in thead, first columns th in tbody,
    every other body row has another ground.
    """
    shown = cells.join(header, "table_id").filter(F.col("cell").isNotNull() & (F.col("rowspan") > 0) & (F.col("colspan") > 0))
    head = F.col("row") <= F.col("header_rows")
    tag = F.when(head | (F.col("col") == 1), "th").otherwise("td")
    span = lambda name: F.when(F.col(name) > 1, F.concat(F.lit(f' {name}="'), F.col(name).cast("string"), F.lit('"'))).otherwise("")
    cell = F.concat(F.lit("<"), tag, F.when(head, "").otherwise(' style="text-align: center;"'), span("rowspan"), span("colspan"), F.lit(">"), html_escaped(F.col("cell")), F.lit("</"), tag, F.lit(">"))
    ordered = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, "t"))), lambda x: x["t"]), "")
    rows = shown.select("table_id", "row", "col", "header_rows", cell.alias("t")).groupBy("table_id", "row", "header_rows").agg(ordered("col").alias("t"))
    ground = F.when((F.col("row") - F.col("header_rows")) % 2 == 0, "bg-gray-50").otherwise("bg-white")
    open_ = F.when(F.col("row") <= F.col("header_rows"), "<tr>").otherwise(F.concat(F.lit('<tr class="'), ground, F.lit('">')))
    rows = rows.select("table_id", "row", (F.col("row") <= F.col("header_rows")).alias("head"), F.concat(open_, "t", F.lit("</tr>")).alias("t"))
    part = lambda which: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(which, F.struct("row", "t")))), lambda x: x["t"]), "")
    out = rows.groupBy("table_id").agg(part(F.col("head")).alias("a"), part(~F.col("head")).alias("b"))
    body = F.when(F.col("b") != "", F.concat(F.lit("<tbody>"), "b", F.lit("</tbody>"))).otherwise("")
    return out.select("table_id", F.concat(F.lit('<table class="obc-table"><thead>'), "a", F.lit("</thead>"), body, F.lit("</table>")).alias("html"))


# Signs of a private font and what they stand for.
GLYPHS = [("\uf0b3", ">="), ("\uf0b2", "<=")]


def smart_cells(cells: DataFrame, header: DataFrame) -> DataFrame:
    """table_id, row, col, cell, header_rows, rowspan, colspan with inferred spans; a cell that another one covers is left out.

    In the head, and apart from it in the body, equal neighbours in the first column are one cell, and in the head the
    blanks to the right of a cell from the second column on belong to it.
    """
    rows = cells.join(header, "table_id").withColumn("head", F.col("row") <= F.col("header_rows"))
    value = blank_to_null(F.col("cell"))
    down = Window.partitionBy("table_id", "col", "head").orderBy("row")
    starts = F.when((F.col("col") == 1) & (value == F.lag(value).over(down)), 0).otherwise(1)
    right = Window.partitionBy("table_id", "row").orderBy("col")
    opens = F.when(F.col("head") & (F.col("col") > 2) & F.col("cell").isNull(), 0).otherwise(1)
    rows = rows.withColumn("_start", starts).withColumn("_open", opens).withColumn("_run", F.sum("_start").over(down)).withColumn("_span", F.sum("_open").over(right))
    rows = rows.withColumn("rowspan", F.count("*").over(Window.partitionBy("table_id", "col", "head", "_run"))).withColumn("colspan", F.count("*").over(Window.partitionBy("table_id", "row", "_span")))
    return rows.filter("_start = 1 AND _open = 1").select("table_id", "row", "col", "cell", "header_rows", "rowspan", "colspan")


def smart_html(cells: DataFrame, header: DataFrame) -> DataFrame:
    """table_id, html of grids with inferred spans, a line for each tag of rows and cells."""
    rows = smart_cells(cells, header)
    head = F.col("row") <= F.col("header_rows")
    text = quotes_escaped(html_escaped(F.coalesce("cell", F.lit(""))))
    for sign, plain in GLYPHS:
        text = F.replace(text, F.lit(sign), F.lit(plain))
    tag = F.when(head | (F.col("col") == 1), "th").otherwise("td")
    attribute = lambda name: F.when(F.col(name) > 1, F.concat(F.lit(f' {name}="'), F.col(name).cast("string"), F.lit('"'))).otherwise("")
    cell = F.concat(F.lit("<"), tag, attribute("rowspan"), attribute("colspan"), F.lit(">"), text, F.lit("</"), tag, F.lit(">"))
    lines = lambda k, t: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, t))), lambda x: x[t]), "\n")
    rows = rows.withColumn("t", cell).groupBy("table_id", "row", "header_rows").agg(lines("col", "t").alias("cells"))
    stripe = F.when(head, "<tr>").when((F.col("row") - F.col("header_rows")) % 2 == 0, '<tr class="bg-gray-50">').otherwise('<tr class="bg-white">')
    rows = rows.withColumn("t", F.concat(stripe, F.lit("\n"), "cells", F.lit("\n</tr>")))
    part = lambda when: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("row", "t")))), lambda x: x["t"]), "\n")
    found = rows.groupBy("table_id").agg(part(head).alias("h"), part(~head).alias("b"))
    opened = F.concat(F.lit('<table class="obc-table" data-table-id="Table '), F.col("table_id").cast("string"), F.lit('">'))
    body = F.when(F.col("b") != "", F.concat(F.lit("<tbody>\n"), "b", F.lit("\n</tbody>")))
    return found.select("table_id", F.concat_ws("\n", opened, F.lit("<thead>"), "h", F.lit("</thead>"), body, F.lit("</table>")).alias("html"))


def column_clusters(words: DataFrame, gap: float) -> DataFrame:
    """Page, x, text and more, with column (from 1) and centre: words of a page are one column until a gap in x.

    Words in the order of x begin a new column where the next x is more than gap away; a column's centre is its mean x.
    """
    w = Window.partitionBy("page").orderBy("x")
    rows = words.filter("x IS NOT NULL").withColumn("_new", F.when(F.col("x") - F.lag("x").over(w) > gap, 1).otherwise(0))
    rows = rows.withColumn("column", (F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0)) + 1).cast("int")).drop("_new")
    return rows.withColumn("centre", F.round(F.avg("x").over(Window.partitionBy("page", "column")), 6))
