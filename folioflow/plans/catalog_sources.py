"""Registered queries on sources, overrides and flat content."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.operators import relational as R
from folioflow.operators import tree as H
from folioflow.plans.catalog import B, M, add
from folioflow.sources import files

# ---- nested and keyed JSON, blocks of pages
add("S01_nested_json", lambda s, d: H.flattened(files.parts_of(H.nested(M(s, d, "nodes")).select(F.to_json(F.struct("id", "title", "sections")).alias("value")))),
    "SELECT id, type, parent_id, title, CAST(row_number() OVER (PARTITION BY parent_id ORDER BY seq) AS INT) AS seq FROM nodes WHERE type IN ('section', 'subsection')", "nodes")
add("S02_keyed_json", lambda s, d: files.tables_of(M(s, d, "tables").select(F.to_json(F.create_map("id", F.struct("title", "page", "html"))).alias("value"))).select("id", "title", "page", "html"), "SELECT id, title, page, html FROM tables", "tables")
add("S06_page_text", lambda s, d: files.text_blocks(_blocks(s, d), 240.0).select("page", F.sha2("text", 256).alias("sha")),
    "SELECT user_id AS page, sha256(string_agg(event_type, chr(10) ORDER BY value, event_id, event_type)) AS sha FROM events WHERE value >= 60 AND value + 10 <= 180 GROUP BY user_id")
add("S07_rows_of_blocks", lambda s, d: files.rows_of_blocks(_blocks(s, d)).select("page", F.size("rows").cast("long").alias("n"), F.sha2(F.array_join("rows", "|"), 256).alias("sha")),
    """WITH RECURSIVE e AS MATERIALIZED (SELECT user_id AS page, value AS y, event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id, event_type) AS n FROM events),
  r AS (SELECT page, n, y AS top, t FROM e WHERE n = 1 UNION ALL SELECT e.page, e.n, CASE WHEN e.y - r.top <= 5 THEN r.top ELSE e.y END, e.t FROM r JOIN e ON e.page = r.page AND e.n = r.n + 1),
  g AS (SELECT page, top, string_agg(t, ' ' ORDER BY n) AS line FROM r GROUP BY page, top) SELECT page, count(*) AS n, sha256(string_agg(line, '|' ORDER BY top)) AS sha FROM g GROUP BY page""")


def _blocks(s, d):
    """Blocks of pages: a user's events, by value from top to bottom."""
    return B(s, d, "events").select(F.col("user_id").alias("page"), F.col("event_id").cast("double").alias("x0"), F.col("value").alias("y0"), (F.col("value") + 10).alias("y1"), F.col("event_type").alias("text"))


# ---- joins by place, overrides, merges
add("J12_zip_by_place", lambda s, d: R.zipped(M(s, d, "tables").select("page", F.col("id").alias("table_id")), M(s, d, "nodes").filter("type = 'subsection'").select("page", F.col("id").alias("node_id")), "page", "table_id", "node_id"),
    "SELECT a.page, k, table_id, node_id FROM (SELECT page, id AS table_id, row_number() OVER (PARTITION BY page ORDER BY id) AS k FROM tables) a JOIN (SELECT page, id AS node_id, row_number() OVER (PARTITION BY page ORDER BY id) AS k FROM nodes WHERE type = 'subsection') b USING (page, k)", "tables", "nodes")
add("J13_overridden", lambda s, d: R.overridden(M(s, d, "tables").select("id", "title", "html", "source"), _overrides(s, d)),
    """, o AS (SELECT t.id, p_size > 30 AS patch, concat('<p>', p_brand, '</p>') AS html FROM part JOIN tables t ON t.title = p_name AND regexp_extract(t.id, '([0-9]+)(\\.-A|B)?$', 1) = CAST(p_partkey AS VARCHAR) WHERE p_size > 20)
    SELECT t.id, title, CASE WHEN o.id IS NULL OR patch AND t.html IS NULL THEN t.html WHEN patch THEN concat(t.html, o.html) ELSE o.html END AS html, CASE WHEN o.id IS NULL OR patch AND t.html IS NULL THEN source ELSE 'manual_override' END AS source FROM tables t LEFT JOIN o ON o.id = t.id""", "tables")
add("J14_selected_merged", lambda s, d: R.upserted(M(s, d, "tables").filter("source IS NOT NULL").select("id", "title", "page"), R.selected(M(s, d, "tables").filter("html IS NOT NULL").select("id", F.upper("title").alias("title"), "page"), M(s, d, "refs").filter("target_type = 'table'").select(F.col("target_id").alias("id")), "id"), "id"),
    ", n AS (SELECT id, upper(title) AS title, page FROM tables WHERE html IS NOT NULL AND id IN (SELECT target_id FROM refs WHERE target_type = 'table')) SELECT id, title, page FROM n UNION ALL SELECT id, title, page FROM tables WHERE source IS NOT NULL AND id NOT IN (SELECT id FROM n)", "tables", "refs")


def _overrides(s, d):
    """id, patch (added to what is there, or in its place), html: of the larger parts' tables."""
    large = B(s, d, "part").filter("p_size > 20").select(F.col("p_partkey").cast("string").alias("k"), (F.col("p_size") > 30).alias("patch"), F.concat(F.lit("<p>"), "p_brand", F.lit("</p>")).alias("html"))
    return M(s, d, "tables").select("id", F.regexp_extract("id", r"(\d+)(?:\.-A|B)?$", 1).alias("k")).join(large, "k").drop("k")


add("H16_flat_content", lambda s, d: H.flat_content(M(s, d, "nodes")).select("id", F.sha2("content", 256).alias("sha")),
    "SELECT parent_id AS id, sha256(rtrim(string_agg(concat('#### ', id, '. ', title, chr(10), CASE WHEN content <> '' THEN chr(10) || content ELSE '' END), chr(10) || chr(10) ORDER BY seq), chr(10))) AS sha FROM nodes WHERE type = 'article' GROUP BY parent_id", "nodes")
