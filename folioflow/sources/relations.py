"""The relations that the operators read: base tables, and the document model derived from them.

The model is a five-level tree (part, section, subsection, article, clause) with dotted ids, its tables and references,
and the code lines of each article. The derivations are plain SQL that any engine can run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")

#: nodes(id, type, part, parent_id, title, content, page, seq)
NODES = """
WITH sections AS (
  SELECT concat(CAST(r_regionkey + 1 AS STRING), '.', CAST(n_nationkey + 1 AS STRING)) AS id, r_regionkey + 1 AS part, n_nationkey, n_name
  FROM nation JOIN region ON n_regionkey = r_regionkey),
subsections AS (
  SELECT concat(s.id, '.', CAST(c_custkey AS STRING)) AS id, s.part AS part, s.id AS parent_id, c_custkey, c_name, c_mktsegment, c_acctbal
  FROM customer JOIN sections s ON c_nationkey = s.n_nationkey),
articles AS (
  SELECT concat(u.id, '.', CAST(o_orderkey AS STRING)) AS id, u.part AS part, u.id AS parent_id, o_orderkey, o_orderpriority, o_orderstatus
  FROM orders JOIN subsections u ON o_custkey = u.c_custkey),
items AS (
  SELECT l_orderkey, l_returnflag, l_linestatus, l_quantity,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n
  FROM lineitem)
SELECT CAST(r_regionkey + 1 AS STRING) AS id, 'part' AS type, r_regionkey + 1 AS part, CAST(NULL AS STRING) AS parent_id, r_name AS title,
  CAST(NULL AS STRING) AS content, 1 AS page, CAST(r_regionkey + 1 AS BIGINT) AS seq FROM region
UNION ALL SELECT id, 'section', part, CAST(part AS STRING), n_name, CAST(NULL AS STRING), n_nationkey + 1, CAST(n_nationkey + 1 AS BIGINT) FROM sections
UNION ALL SELECT id, 'subsection', part, parent_id, c_name, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE concat(c_mktsegment, ' rules') END,
  CAST(c_custkey % 500 + 1 AS INT), c_custkey FROM subsections
UNION ALL SELECT id, 'article', part, parent_id, CASE WHEN o_orderkey % 19 = 0 THEN 'Reserved' ELSE o_orderpriority END,
  concat('Status ', o_orderstatus), CAST(o_orderkey % 900 + 1 AS INT), o_orderkey FROM articles
UNION ALL SELECT concat(a.id, '.(', CAST(n AS STRING), ')'), 'clause', a.part, a.id, CAST(NULL AS STRING),
  concat(l_returnflag, ' ', l_linestatus, ' ', CAST(CAST(l_quantity AS INT) AS STRING)), CAST(a.o_orderkey % 900 + 1 AS INT), n
FROM items JOIN articles a ON l_orderkey = a.o_orderkey
"""

#: grid tables of the model: (id, title, parent_id, page, html, source); some parents are articles with a letter, some don't exist
TABLES = """
SELECT concat('Table ', CAST(p_partkey % 9 + 1 AS STRING), '.', CAST(p_partkey % 13 + 1 AS STRING), '.', CAST(p_partkey % 17 + 1 AS STRING), '.', CAST(p_partkey AS STRING),
    CASE WHEN p_partkey % 5 = 0 THEN '.-A' WHEN p_partkey % 5 = 1 THEN 'B' ELSE '' END) AS id,
  p_name AS title, CASE WHEN p_partkey % 11 = 0 THEN CAST(NULL AS STRING) ELSE CAST(p_partkey % 3000 AS STRING) END AS parent_id, CAST(p_partkey % 400 + 1 AS INT) AS page,
  CASE WHEN p_partkey % 4 = 0 THEN CAST(NULL AS STRING) ELSE concat('<table><tr><td>', p_brand, '</td></tr></table>') END AS html,
  CASE WHEN p_partkey % 6 = 0 THEN CAST(NULL AS STRING) ELSE p_type END AS source
FROM part
"""

# The lines of an item: where each stands, when it is there, and its text.
_ITEM_LINES = [
    ("n * 3", None, """concat('(', CAST(n + CAST(l_partkey % 29 = 0 AS INT) AS STRING), ') The work ', l_returnflag, ' conforms to ',
    CASE l_partkey % 7 WHEN 0 THEN concat('Table 9.', CAST(l_suppkey % 30 + 1 AS STRING), '.3.', CAST(n AS STRING), '.') WHEN 1 THEN concat('Article 9.', CAST(l_suppkey % 30 + 1 AS STRING), '.2.', CAST(n AS STRING), 'A')
      WHEN 2 THEN 'Sentence (2) and Clause (3)' WHEN 3 THEN concat('Section 9.', CAST(l_suppkey % 30 + 1 AS STRING)) WHEN 4 THEN concat('Subsection 9.', CAST(l_suppkey % 30 + 1 AS STRING), '.4A')
      WHEN 5 THEN concat('[the rule](#page-12-3) and ', chr(92), '(x', chr(92), ')') ELSE 'the *old* rule and m<sup>2</sup>' END,
    CASE WHEN l_suppkey % 9 = 0 THEN '' WHEN l_suppkey % 9 = 1 THEN ' and' ELSE '.' END)"""),
    ("n * 3 + 1", "CAST(l_quantity AS INT) % 2 = 0", """CASE l_partkey % 8 WHEN 0 THEN '(a) first case,' WHEN 1 THEN '(iv) fourth case' WHEN 2 THEN '**Bold heading**' WHEN 3 THEN '2012 Building Code'
      WHEN 4 THEN '17' WHEN 5 THEN '(See Note A-9.1.)' WHEN 6 THEN '| A | B | C |' ELSE 'more of the same text' END"""),
    ("n * 3 + 2", "CAST(l_quantity AS INT) % 10 = 1", "CASE WHEN l_partkey % 3 = 0 THEN 'Notes to Table 9.1.1.1.' ELSE '- (1.2) note item' END"),
]
_HEADS = """SELECT o_orderkey AS doc, o_orderkey % 900 + 1 AS page, CAST(0 AS BIGINT) AS line, concat(CAST(o_custkey % 9 + 1 AS STRING), '.', CAST(o_custkey % 7 + 1 AS STRING), '.', CAST(o_custkey % 11 + 1 AS STRING),
    CASE o_orderkey % 8 WHEN 0 THEN concat('.', CAST(o_orderkey % 23 + 1 AS STRING), 'A. ') WHEN 1 THEN 'A. ' WHEN 2 THEN '. ' WHEN 3 THEN '. 0A. ' WHEN 4 THEN concat('A.', CAST(o_orderkey % 23 + 1 AS STRING), '. ') ELSE concat('.', CAST(o_orderkey % 23 + 1 AS STRING), '. ') END,
    CASE WHEN o_orderkey % 13 = 0 THEN 'lower case title' ELSE concat('Rules of ', o_orderpriority) END) AS text FROM orders"""
_ITEMS = """SELECT l_orderkey AS doc, l_partkey, l_suppkey, l_quantity, l_returnflag,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n
  FROM lineitem"""
_ITEM_PAGE = "doc % 900 + 1 + CAST(n > 4 AS INT)"

#: code lines (doc, page, line, text): an article's heading and its clauses, with every kind of line and of blemish
LINES = f"""
WITH items AS ({_ITEMS})
{_HEADS}
{" ".join(f"UNION ALL SELECT doc, {_ITEM_PAGE}, {at}, {text} FROM items{f' WHERE {when}' if when else ''}" for at, when, text in _ITEM_LINES)}
"""

#: the same as Spark reads it: items are scanned and numbered once, and each is exploded into its lines
_LINES_IN_ONE_PASS = f"""
WITH items AS ({_ITEMS})
{_HEADS}
UNION ALL SELECT doc, page, at, text FROM (SELECT doc, {_ITEM_PAGE} AS page, inline(filter(array({", ".join(f"named_struct('at', CAST({at} AS BIGINT), 'text', CASE WHEN {when or 'true'} THEN {text} END)" for at, when, text in _ITEM_LINES)}), x -> x.text IS NOT NULL)) AS (at, text) FROM items)
"""

#: cross references of the model: (source_id, target_id, target_type)
REFS = """
SELECT CAST(l_orderkey AS STRING) AS source_id, CASE WHEN l_partkey % 4 = 0 THEN concat('Table ', CAST(l_partkey % 9 + 1 AS STRING), '.', CAST(l_partkey % 13 + 1 AS STRING), '.', CAST(l_partkey % 17 + 1 AS STRING), '.', CAST(l_partkey AS STRING),
    CASE WHEN l_partkey % 5 = 0 THEN '.-A' WHEN l_partkey % 5 = 1 THEN 'B' ELSE '' END) ELSE CAST(l_suppkey * 7 AS STRING) END AS target_id,
  CASE WHEN l_partkey % 4 = 0 THEN 'table' ELSE 'article' END AS target_type
FROM lineitem
"""

#: cells (table_id, row, col, cell) of grids; blanks and merged cells among them
CELLS = """
SELECT l_orderkey AS table_id, row, col, CASE
    WHEN (l_partkey + col * 7) % 5 = 0 THEN CAST(NULL AS STRING) WHEN (l_partkey + col * 3) % 7 = 0 THEN '  ' WHEN (l_partkey + col) % 4 = 0 THEN 'same'
    WHEN col = 1 THEN concat('Item ', l_returnflag) ELSE CAST(CAST(l_quantity AS INT) + col AS STRING) END AS cell
FROM (SELECT l_orderkey, l_partkey, l_quantity, l_returnflag,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS row FROM lineitem) t
  CROSS JOIN (SELECT 1 AS col UNION ALL SELECT 2 UNION ALL SELECT 3) c
"""

#: forms of marked-up text; n is an item's number, k another
FORMS = [
    "- **({n})** The wall shall conform to Sentence 9.{k}.3.2.(1) and Table 9.{k}.3.2.-A.",
    "  - ({n}) Every beam in Part 9 of Section 9.{k}.4. is as in Subsection 9.{k}.4.",
    "- (a) first case, see Article 9.{k}.2.3. and Clause 9.{k}.2.3.(1)(b)",
    "- (iv) fourth case **({n})** inline",
    "- (1.{n}) decimal clause (b) of it",
    "- (See Note A-9.{k}.1.)",
    "- . (See Notes A-9.{k}.1. and A-9.{k}.2.)",
    "**Notes to Table 9.{k}.3.2.:**",
    '<h5 class="table-notes-title">Notes to Table 9.{k}.3.2.:</h5>\n({n}) Q = allowed\n- (7) stays',
    "Notes to Table 9.{k}.3.2.-A:",
    "#### Table 9.{k}.3.2.-A Live loads\n*Forming Part of Sentence 9.{k}.3.2.(1)*",
    "### Table 9.{k}.3.2\n\n**Spans of joists**\n*Forming part of Article 9.{k}.3.2.*",
    "**Table 9.{k}.3.2. Nails** Forming Part of Sentence 9.{k}.3.2.(2)",
    "**Table 9.{k}.3.2. Bolts**",
    '<h4 class="table-title">Table 9.{k}.3.2. Panels</h4>',
    "where:\nQ is the flow, in L/s\nSs = the snow load\n\n- T = kept\nother line",
    "| Span, m | Size |\n|---|---|\n| {n} | 38 x 89 |\n| 4 |  |",
    "9.{k}.3.2. to 9.{k}.3.4.)",
    "9.{k}.3.{n}.",
    "the depth of snow\ndrifts.\n.",
    "(See also Sections 9.{k}.3. to\n9.{k}.4.)",
    "9.{k}.3. Stairs\nand ramps\nof dwellings",
    "is calculated as follows: x = 3 a + b and 5 °C or 15m² >= 3 +/- 1, 10 °F",
    "shall be determined by the table below\nand continues in lower case\nBut not this",
    "17",
    "*Note* on a *rule* with <sup>3</sup> and **9.{k}.3.2.** in bold",
    "[ARTICLE:9.{k}.1.1:Scope]",
    "9.{k}.3.2. 9.{k}.3.2. twice",
    "the load shall be calculated from the area",
    "  | Joist | Load |\n  |---|---|\n  | {n} | 1.9 |\n| lone",
    '<h4 class="table-title">Table 9.{k}.3.2</h4>\n<p class="x"><em>Forming Part of Sentence 9.{k}.3.2.({n})</em></p>',
    '<h5 class="table-notes-title"><h5 class="table-notes-title">Notes to Table 9.{k}.3.3.:</h5></h5>\n({n}) R = rafter',
    "### **Table 9.{k}.5.{n} Posts and piers** Forming Part of Sentences 9.{k}.5.{n}.(1), (2)\n| Post | Load |\n|---|---|\n| {n} | 2 |\n![](x.png)\nNotes to Table 9.{k}.5.{n}:\n- (1) first\n(2) second",
    "### Table 9.{k}.5.{n}\n\n**Braces**\n*Forming Part of Sentence 9.{k}.5.{n}.(3)*\nBrace {n} | 4\nno pipes here",
    "### Table 9.{k}.5.{n} (Cont'd)\n| {n} | 7 |",
    "Table 9.6.6.1. Sizes\nForming Part of Sentence 9.6.6.1.(1)\n38 / 89\nWidth of posts\n\nNot a row\n(3) The clause ends it",
    "<table><tr><td>{n}</td></tr></table>\nwhere\nh = height of {n}\n(A) capital",
    "h = 3 + {n}\nThe snow load on a Wall (See Note A-9.{k}.) is 4 m² at 5 °C",
    "*Italic line of the rule*\nC.A. Number {n} Division B Compliance\nSmall Medium {n} rooms",
    "Table 9.{k}.7-A, Table 9.{k}.8-B and Table 9.{k}.9-C but see (**{n})** of them",
]


def _form(text: str) -> str:
    """A form as an SQL expression."""
    import re

    made = {"{n}": "CAST(n AS STRING)", "{k}": "CAST(k AS STRING)", "\n": "chr(10)"}
    return f"concat({', '.join(made.get(x, repr_sql(x)) for x in re.split(r'({n}|{k}|\n)', text) if x)})"


def repr_sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: marked-up text (doc, page, line, text): a heading and one form for each line item; a text may have several lines
MARKED = f"""
WITH items AS (
  SELECT l_orderkey AS doc, l_partkey, l_suppkey % 30 + 1 AS k,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n
  FROM lineitem)
SELECT o_orderkey AS doc, o_orderkey % 900 + 1 AS page, CAST(0 AS BIGINT) AS line, concat(repeat('#', CAST(o_orderkey % 4 + 1 AS INT)), CASE WHEN o_orderkey % 3 = 0 THEN ' Section ' ELSE ' ' END,
    CAST(o_custkey % 4 + 8 AS STRING), '.', CAST(o_custkey % 7 + 1 AS STRING), '.', CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN '3.' WHEN 2 THEN '3A.' WHEN 3 THEN '3.5.' WHEN 4 THEN '3A.5.' ELSE '3.5B.' END,
    CASE o_orderkey % 5 WHEN 0 THEN ' **Loads** (See Note A-9.1.)' WHEN 1 THEN ' Spans e2' WHEN 2 THEN ' *Rules* of **r3**' ELSE concat(' ', o_orderpriority) END) AS text FROM orders
UNION ALL SELECT doc, doc % 900 + 1, n, CASE l_partkey % {len(FORMS)} {" ".join(f"WHEN {i} THEN {_form(x)}" for i, x in enumerate(FORMS))} END FROM items
"""

#: Relations that Spark makes by a statement of its own.
IN_SPARK = {"lines": _LINES_IN_ONE_PASS}
MODEL = {"marked": MARKED, "nodes": NODES, "tables": TABLES, "lines": LINES, "refs": REFS, "cells": CELLS}


#: Rows that one task sorts and joins of a large table. Where the tree is derived, items are dealt by this number, not by the
#: session's number of partitions, so a task's memory doesn't grow with them.
PIECE_ROWS = 500_000
#: The keys that large tables are dealt by for a relation.
DEALT = {"nodes": {"lineitem": "l_orderkey", "orders": "o_custkey"}}


def pieces_of(spark: SparkSession, n_rows: int, size: int) -> int | None:
    """The number of pieces of size rows that so many rows make; None if there is a core for each."""
    n = -(-n_rows // size)
    return n if n > spark.sparkContext.defaultParallelism else None


def pieces(rows: DataFrame) -> int | None:
    """pieces_of rows by PIECE_ROWS; of a table's rows only its files' heads are read."""
    return pieces_of(rows.sparkSession, rows.count(), PIECE_ROWS)


def tree_pieces(spark: SparkSession, sf_dir: str) -> int | None:
    """pieces_of the tree's nodes by PIECE_ROWS; below the sections, each is a row of one of three tables."""
    return pieces_of(spark, sum(base(spark, sf_dir, t).count() for t in ("customer", "orders", "lineitem")), PIECE_ROWS)


def dealt(rows: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """rows in n pieces by their keys; as they are if n is None."""
    return rows.repartition(n, *keys) if n else rows


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def model(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A relation of the document model; base tables are seen by this statement alone."""
    text = IN_SPARK.get(name) or MODEL[name]
    tables = {t: base(spark, sf_dir, t) for t in BASE if f" {t} " in text.replace("\n", " ").replace(")", " ").replace(",", " ") + " "}
    for t, df in tables.items():
        key = DEALT.get(name, {}).get(t)
        (dealt(df, pieces(df), key) if key else df).createOrReplaceTempView(f"_ff_{t}")
        text = _renamed(text, t)
    return spark.sql(text)


def _renamed(text: str, table: str) -> str:
    import re

    return re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 _ff_{table}", text)


def articles(lines: DataFrame) -> DataFrame:
    """doc, page, content: the lines of each document joined in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"])
    return lines.groupBy("doc").agg(F.min("page").alias("page"), F.array_join(ordered, "\n").alias("content"))


MARKED_ARTICLES_SQL = f"SELECT doc, min(page) AS page, string_agg(text, chr(10) ORDER BY line, text) AS content FROM ({MARKED}) l GROUP BY doc"
ARTICLES_SQL = f"SELECT doc, min(page) AS page, string_agg(text, chr(10) ORDER BY line, text) AS content FROM ({LINES}) l GROUP BY doc"
