"""Registered queries on ordered rows, code text, grids, quality rules and write modes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import grids as G
from folioflow.operators import ordered as W
from folioflow.operators import quality as V
from folioflow.operators import relational as R
from folioflow.operators import tree as H
from folioflow.sources.relations import ARTICLES_SQL
from folioflow.plans.catalog import B, DOC_LINES, LINE_TYPE_SQL, M, add, art, doc_lines, mart

# ---- ordered rows
_DOWN = "last_value(CASE WHEN trim(cell) <> '' THEN cell END IGNORE NULLS) OVER (PARTITION BY table_id, col ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
add("W01_fill_down", lambda s, d: W.fill_down(M(s, d, "cells")), f"SELECT table_id, row, col, {_DOWN} AS cell FROM cells", "cells")
add("W02_gaps", lambda s, d: W.gaps(B(s, d, "lineitem"), "l_orderkey", "l_linenumber"),
    "SELECT l_orderkey, a AS after, b AS before, array_to_string(range(a + 1, b), ',') AS missing FROM (SELECT l_orderkey, l_linenumber AS a, lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS b FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) WHERE b > a + 1")
add("W03_order_violations", lambda s, d: W.order_violations(B(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q")), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "q"),
    "SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT) AS q, lag(CAST(l_quantity AS INT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS before FROM lineitem) WHERE before > q")
add("W04_clause_gap", lambda s, d: art(s, d).select("doc", W.first_gap(F.transform(F.regexp_extract_all("content", F.lit(r"(?m)^\((\d+)\) "), 1), lambda x: x.cast("int")), 1).alias("gap")).filter("gap IS NOT NULL"),
    ", n AS (SELECT doc, v, min(line) AS line FROM (SELECT doc, line, CAST(regexp_extract(text, '^[(]([0-9]+)[)] ', 1) AS INT) AS v FROM lines WHERE regexp_matches(text, '^[(][0-9]+[)] ')) GROUP BY doc, v), p AS (SELECT doc, line, v AS a, lead(v) OVER (PARTITION BY doc ORDER BY line) AS b FROM n) SELECT doc, arg_min(concat(a, '_to_', b), line) AS gap FROM p WHERE b - a > 1 GROUP BY doc", "lines")
add("W05_note_runs", lambda s, d: B(s, d, "conversations").withColumn("n", F.length("text") % 10).withColumn("down", F.when(F.col("n") <= F.lag("n").over(W.Window.partitionBy("conv_id").orderBy("turn", "text")), 1).otherwise(0)).groupBy("conv_id").agg((F.sum("down") + 1).alias("runs")),
    "SELECT conv_id, CAST(sum(down) + 1 AS BIGINT) AS runs FROM (SELECT conv_id, CASE WHEN length(text) % 10 <= lag(length(text) % 10) OVER (PARTITION BY conv_id ORDER BY turn, text) THEN 1 ELSE 0 END AS down FROM conversations) GROUP BY conv_id")
_TYPE = LINE_TYPE_SQL
_ASSEMBLED = f""", t AS (SELECT *, {_TYPE} AS type FROM lines),
  r AS (SELECT *, last_value(CASE WHEN starts_with(text, 'Notes to Table') THEN 1 WHEN type IS NOT NULL AND type NOT IN ('subclause', 'subsubclause') THEN 0 END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page, line, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS notes FROM t),
  b AS (SELECT *, sum(CASE WHEN type IS NOT NULL AND type NOT IN ('subclause', 'subsubclause') THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY page, line, text) AS block FROM r WHERE coalesce(notes, 0) = 0)
  SELECT doc, max(CASE WHEN regexp_matches(text, '^[(][0-9]+[)]') THEN CAST(regexp_extract(text, '^[(]([0-9]+)[)]', 1) AS INT) END) AS n, max(page) AS page, string_agg(text, ' ' ORDER BY page, line, text) AS content
  FROM b GROUP BY doc, block HAVING arg_min(coalesce(type, ''), (page, line, text)) = 'clause'"""
add("W06_clause_assembly", lambda s, d: W.assembled(M(s, d, "lines"), X.line_type(F.col("text")), X.clause_number(F.col("text"))), _ASSEMBLED, "lines")
add("W07_notes_region", lambda s, d: _notes(s, d), f", t AS (SELECT *, {_TYPE} AS type FROM lines), r AS (SELECT *, last_value(CASE WHEN starts_with(text, 'Notes to Table') THEN 1 WHEN type IS NOT NULL THEN 0 END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page, line, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS notes FROM t) SELECT doc, count(*) AS n FROM r WHERE notes = 1 GROUP BY doc", "lines")


def _notes(s: SparkSession, d: str) -> DataFrame:
    w = W.Window.partitionBy("doc").orderBy("page", "line", "text")
    state = F.last(F.when(F.col("text").startswith("Notes to Table"), 1).when(X.line_type(F.col("text")).isNotNull(), 0), ignorenulls=True).over(w)
    return M(s, d, "lines").withColumn("notes", state).filter("notes = 1").groupBy("doc").agg(F.count("*").alias("n"))


add("W08_repeated_blocks", lambda s, d: W.first_of(M(s, d, "lines").filter(F.col("text").contains("Table 9")).withColumn("t", F.regexp_extract("text", r"(Table 9\.\d+)", 1)), ["doc", "t"], ["line", "text"]).select("doc", "t", "line"), "SELECT doc, t, line FROM (SELECT doc, line, regexp_extract(text, '(Table 9[.][0-9]+)', 1) AS t, row_number() OVER (PARTITION BY doc, regexp_extract(text, '(Table 9[.][0-9]+)', 1) ORDER BY line, text) AS rn FROM lines WHERE contains(text, 'Table 9')) WHERE rn = 1", "lines")


def _parts(s: SparkSession, d: str) -> DataFrame:
    return B(s, d, "lineitem").select(F.col("l_orderkey").alias("owner"), F.col("l_linenumber").alias("page"), (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("idx"), F.when(F.col("l_partkey") % 5 != 0, F.col("l_returnflag")).alias("table_id"), F.col("l_quantity").cast("int").alias("rows"))


add("W10_continued_tables", lambda s, d: W.continuations(_parts(s, d)).drop("run"),
    """WITH p AS (SELECT l_orderkey AS owner, l_linenumber AS page, l_partkey * 100000 + l_suppkey AS idx, CASE WHEN l_partkey % 5 <> 0 THEN l_returnflag END AS table_id, CAST(l_quantity AS INT) AS rows FROM lineitem),
    q AS (SELECT *, CASE WHEN table_id = lag(table_id) OVER w AND page - lag(page) OVER w <= 1 THEN 0 ELSE 1 END AS new FROM p WINDOW w AS (PARTITION BY owner ORDER BY page, idx)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY owner ORDER BY page, idx) AS run FROM q)
    SELECT owner, arg_min(coalesce(table_id, chr(0)), (page, idx)) AS t, min(page) AS page, max(page) AS end_page, count(*) AS parts, CAST(sum(rows) AS BIGINT) AS rows FROM r GROUP BY owner, run""")
from folioflow.plans.catalog import SQL as _SQL  # noqa: E402

_SQL["W10_continued_tables"] = "SELECT owner, nullif(t, chr(0)) AS table_id, page, end_page, parts, rows FROM (" + _SQL["W10_continued_tables"] + ")"
add("W11_equal_width_chain", lambda s, d: _widths(s, d), "WITH p AS (SELECT l_orderkey AS owner, l_linenumber AS page, l_partkey * 100000 + l_suppkey AS idx, l_suppkey % 3 + 2 AS cols FROM lineitem) SELECT owner, page, idx FROM (SELECT *, lead(cols) OVER (PARTITION BY owner ORDER BY page, idx) AS nxt FROM p) WHERE nxt = cols")


def _widths(s: SparkSession, d: str) -> DataFrame:
    rows = B(s, d, "lineitem").select(F.col("l_orderkey").alias("owner"), F.col("l_linenumber").alias("page"), (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("idx"), (F.col("l_suppkey") % 3 + 2).alias("cols"))
    return rows.withColumn("nxt", F.lead("cols").over(W.Window.partitionBy("owner").orderBy("page", "idx"))).filter("nxt = cols").select("owner", "page", "idx")


add("W12_first_by_id", lambda s, d: W.first_of(B(s, d, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id"), "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
add("W13_first_by_content", lambda s, d: W.first_of(B(s, d, "documents").select("doc_id", F.md5("text").alias("hash")), ["hash"], ["doc_id"]), "SELECT doc_id, hash FROM (SELECT doc_id, md5(text) AS hash, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
add("W14_duplicate_suspects", lambda s, d: W.duplicate_suspects(B(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))), "SELECT id, first_id FROM (SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY length(text), substring(text, 1, 100)) AS first_id FROM documents WHERE length(text) > 200) WHERE id > first_id")
add("W15_distinct_rows", lambda s, d: G.distinct_rows(M(s, d, "cells")), "SELECT table_id, count(DISTINCT r) AS rows FROM (SELECT table_id, row, to_json(list(coalesce(cell, '') ORDER BY col)) AS r FROM cells GROUP BY table_id, row) GROUP BY table_id", "cells")
add("W16_row_spans", lambda s, d: W.row_spans(M(s, d, "cells")).withColumn("rowspan", F.col("rowspan").cast("long")), ", a AS (SELECT table_id, row, col, trim(coalesce(cell, '')) AS v FROM cells), b AS (SELECT *, CASE WHEN v <> '' AND v = lag(v) OVER (PARTITION BY table_id, col ORDER BY row) THEN 0 ELSE 1 END AS new FROM a), c AS (SELECT *, sum(new) OVER (PARTITION BY table_id, col ORDER BY row) AS run FROM b) SELECT table_id, row, col, CASE WHEN new = 1 THEN count(*) OVER (PARTITION BY table_id, col, run) ELSE 0 END AS rowspan FROM c", "cells")
add("W17_column_spans", lambda s, d: W.column_spans(M(s, d, "cells")).withColumn("colspan", F.col("colspan").cast("long")), ", c AS (SELECT *, sum(CASE WHEN cell IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY table_id, row ORDER BY col) AS run FROM cells) SELECT table_id, row, col, CASE WHEN cell IS NOT NULL THEN count(*) OVER (PARTITION BY table_id, row, run) ELSE 0 END AS colspan FROM c", "cells")
add("W18_recent_visits", lambda s, d: W.most_recent(B(s, d, "events").withColumn("page", (F.col("event_id") % 40)), "user_id", "page", "ts").select("user_id", "page", "rank"), "SELECT user_id, page, CAST(rank AS INT) AS rank FROM (SELECT user_id, page, row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, page) AS rank FROM (SELECT user_id, event_id % 40 AS page, ts FROM events) GROUP BY user_id, page) WHERE rank <= 8")
add("W19_nearest_visible", lambda s, d: W.nearest(B(s, d, "events").select("user_id", "event_id", (F.col("value") - 20).alias("top")), "user_id", "event_id", "top"), "SELECT user_id, coalesce(arg_min(event_id, (value - 20, event_id)) FILTER (WHERE value - 20 >= 0), arg_min(event_id, (abs(value - 20), event_id))) AS nearest FROM events GROUP BY user_id")
add("W20_rendered_once", lambda s, d: W.first_of(M(s, d, "refs").filter("target_type = 'table'").select("source_id", "target_id"), ["target_id"], ["source_id"]), "SELECT min(source_id) AS source_id, target_id FROM refs WHERE target_type = 'table' GROUP BY target_id", "refs")

# ---- sorts and sets
add("O02_natural_order", lambda s, d: M(s, d, "nodes").filter("type = 'subsection'").select("id", F.row_number().over(W.Window.partitionBy("part").orderBy(H.natural_key(F.col("id")))).alias("rank")), "SELECT id, row_number() OVER (PARTITION BY part ORDER BY CAST(split_part(id, '.', 2) AS INT), CAST(split_part(id, '.', 3) AS INT)) AS rank FROM nodes WHERE type = 'subsection'", "nodes")
add("O03_text_order", lambda s, d: M(s, d, "nodes").filter("type = 'section'").select("part", "id", F.row_number().over(W.Window.partitionBy("part").orderBy("id")).alias("rank")), "SELECT part, id, row_number() OVER (PARTITION BY part ORDER BY id) AS rank FROM nodes WHERE type = 'section'", "nodes")
add("O04_most_issues", lambda s, d: V.findings(art(s, d).select(F.col("doc").alias("id"), "content")).groupBy("id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(30), None)
add("O05_geometric_order", lambda s, d: B(s, d, "events").select("user_id", "event_id", F.row_number().over(W.Window.partitionBy("user_id").orderBy(F.floor("value"), "event_id")).alias("rank")), "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY floor(value), event_id) AS rank FROM events")
add("O09_difference", lambda s, d: M(s, d, "refs").select("target_id").subtract(M(s, d, "tables").select("id")), "SELECT target_id FROM refs EXCEPT SELECT id FROM tables", "refs", "tables")
add("O10_union", lambda s, d: B(s, d, "documents").select("doc_id", "lang").unionByName(B(s, d, "labels").select("doc_id", "quality"), allowMissingColumns=True), "SELECT doc_id, lang, NULL AS quality FROM documents UNION ALL SELECT doc_id, NULL, quality FROM labels")
add("O11_distinct", lambda s, d: B(s, d, "documents").select("lang", "source").distinct(), "SELECT DISTINCT lang, source FROM documents")

# ---- text
add("T01_line_types", lambda s, d: M(s, d, "lines").select("doc", "line", "text", X.line_type(F.col("text")).alias("type")), f"SELECT doc, line, text, {_TYPE} AS type FROM lines", "lines")
add("T02_node_types", lambda s, d: M(s, d, "nodes").select("id", X.node_type(F.col("id")).alias("guess")), "SELECT id, type AS guess FROM nodes", "nodes")
add("T03_article_types", lambda s, d: M(s, d, "lines").filter("line = 0").select("doc", X.article_type(F.regexp_replace(F.replace(F.regexp_extract("text", r"^([0-9.A-Z]+(?: 0A\.)?) ", 1), F.lit(" "), F.lit("")), r"\.$", "")).alias("type")),
    ", i AS (SELECT doc, string_split(concat(split_part(text, '. ', 1), CASE WHEN split_part(text, ' ', 2) = '0A.' THEN '.0A' ELSE '' END), '.') AS p FROM lines WHERE line = 0) SELECT doc, CASE WHEN len(p) < 4 THEN 'article' WHEN p[-1] = '0A' THEN 'article_0a' WHEN regexp_full_match(p[3], '[0-9]+[A-Za-z]') AND regexp_full_match(p[-1], '[0-9]+') THEN 'sub_article' WHEN regexp_full_match(p[-1], '[0-9]+[A-Za-z]') THEN 'article_suffix' ELSE 'article' END AS type FROM i", "lines")
add("T05_references", lambda s, d: art(s, d).select("doc", F.explode(X.references(F.col("content"))).alias("r")).groupBy("r.type", "r.target").agg(F.count("*").alias("n")),
    """, x AS (SELECT 'table' AS type, unnest(regexp_extract_all(content, 'Table\\s+(9\\.[0-9]+\\.[0-9]+\\.[0-9]+[A-Z]?)\\.?', 1)) AS target FROM art UNION ALL SELECT 'clause', unnest(regexp_extract_all(content, '(?:Sentence|Clause)s?\\s+\\(([0-9]+)\\)', 1)) FROM art
    UNION ALL SELECT 'article', unnest(regexp_extract_all(content, 'Articles?\\s+(9\\.[0-9]+\\.[0-9]+\\.[0-9]+[A-Z]?)', 1)) FROM art UNION ALL SELECT 'section', unnest(regexp_extract_all(content, 'Section\\s+(9\\.[0-9]+)', 1)) FROM art
    UNION ALL SELECT 'subsection', unnest(regexp_extract_all(content, 'Subsection\\s+(9\\.[0-9]+\\.[0-9]+[A-Z]?)', 1)) FROM art) SELECT type, target, count(*) AS n FROM x GROUP BY type, target""", "art")
add("T07_reference_paths", lambda s, d: art(s, d).select(F.explode(X.references(F.col("content"))).alias("r")).select("r.*").distinct().select("type", "target", X.reference_path(F.col("target"), F.col("type")).alias("path")),
    """, x AS (SELECT 'table' AS type, unnest(regexp_extract_all(content, 'Table\\s+(9\\.[0-9]+\\.[0-9]+\\.[0-9]+[A-Z]?)\\.?', 1)) AS target FROM art UNION ALL SELECT 'clause', unnest(regexp_extract_all(content, '(?:Sentence|Clause)s?\\s+\\(([0-9]+)\\)', 1)) FROM art
    UNION ALL SELECT 'article', unnest(regexp_extract_all(content, 'Articles?\\s+(9\\.[0-9]+\\.[0-9]+\\.[0-9]+[A-Z]?)', 1)) FROM art UNION ALL SELECT 'section', unnest(regexp_extract_all(content, 'Section\\s+(9\\.[0-9]+)', 1)) FROM art
    UNION ALL SELECT 'subsection', unnest(regexp_extract_all(content, 'Subsection\\s+(9\\.[0-9]+\\.[0-9]+[A-Z]?)', 1)) FROM art)
    SELECT DISTINCT type, target, CASE WHEN regexp_matches(target, '^9[.][^.]+[.][^.]') THEN concat('/code/9.', split_part(target, '.', 2), '.', split_part(target, '.', 3)) END AS path FROM x""", "art")
add("T08_table_ids", lambda s, d: M(s, d, "tables").select(F.col("id").alias("raw"), X.table_id(F.concat("id", F.lit("."))).alias("id")), "SELECT id AS raw, id FROM tables", "tables")
add("T09_table_parents", lambda s, d: M(s, d, "tables").select("id", X.table_parent(F.col("id")).alias("parent")), "SELECT id, CASE WHEN ends_with(id, '.-A') THEN replace(replace(id, '.-A', ''), 'Table ', '') ELSE replace(id, 'Table ', '') END AS parent FROM tables", "tables")
add("T10_article_markers", lambda s, d: _marked(s, d).select("doc", F.explode(X.article_markers(F.col("content"))).alias("a")).select("doc", "a.id", "a.title", F.length("a.body").alias("n")),
    ", m AS (SELECT doc, regexp_replace(content, '^([0-9]+[.][0-9]+[.][0-9]+[A-Z]?[.][0-9]+[A-Z]?)[.]\\s*([^\\n]+)', '[ARTICLE:\\1:\\2]') AS c FROM art) SELECT doc, regexp_extract(c, '^\\[ARTICLE:([^:]+):', 1) AS id, regexp_extract(c, '^\\[ARTICLE:[^:]+:([^\\]]*)\\]', 1) AS title, CAST(length(trim(regexp_replace(c, '^[^\\]]*\\]', ''), ' ')) AS INT) AS n FROM m WHERE starts_with(c, '[ARTICLE:')", "art")


def _marked(s: SparkSession, d: str) -> DataFrame:
    from folioflow.sources.relations import articles

    heading = F.concat(F.when(F.col("line") == 0, F.lit("### ")).otherwise(F.lit("")), "text")
    return articles(M(s, d, "lines").withColumn("text", F.trim(F.regexp_replace(X.marked_articles(heading), r"^(?:### |\n)", ""))))



add("T22_equations", lambda s, d: M(s, d, "marked").filter(X.has_equation(F.col("text"))).groupBy("doc").agg(F.count("*").alias("n")),
    "SELECT doc, count(*) AS n FROM marked WHERE regexp_matches(text, '[=<>±≤≥]') OR regexp_matches(text, '[0-9]+\\s*/\\s*[0-9]+') OR regexp_matches(text, '[²³√∑∫∏]') OR regexp_matches(text, '(?i)[0-9]+\\s*[×x]\\s*10') OR regexp_matches(text, '(?i)\\bsqrt\\s*[(]') OR regexp_matches(text, '(?i)°\\s*[cf]') GROUP BY doc", "marked")



def _norm(name: str, f, sql: str) -> None:
    add(name, lambda s, d: M(s, d, "lines").select("doc", "line", "text", f(F.col("text")).alias("new")).filter("new <> text"), f"SELECT * FROM (SELECT doc, line, text, {sql} AS new FROM lines) WHERE new <> text", "lines")


def _norm_art(name: str, f, sql: str) -> None:
    add(name, lambda s, d: art(s, d).select("doc", F.sha2(f(F.col("content")), 256).alias("sha")), f"SELECT doc, sha256({sql}) AS sha FROM art", "art")


_LINK = "regexp_replace(text, '\\[([^\\]]+)\\]\\(#page-[0-9]+[^)]*\\)', '\\1', 'g')"
_norm("N04_links_unwrapped", X.links_unwrapped, _LINK)
_norm("N05_parens_unescaped", X.parens_unescaped, "replace(replace(text, chr(92) || '(', '('), chr(92) || ')', ')')")
_norm_art("N06_see_notes_joined", X.see_notes_joined, "regexp_replace(content, '(?i)(\\S)\\n+\\s*(\\(See (?:Note|also)[^)]*\\))', '\\1 \\2', 'g')")
_norm("N07_emphasis_removed", X.emphasis_removed, "regexp_replace(regexp_replace(text, '\\*\\*([^*\\n]+)\\*\\*', '\\1', 'g'), '\\*([^*\\n]+)\\*', '\\1', 'g')")
_norm("N03_superscripts", X.superscripts, "replace(text, '<sup>2</sup>', '²')")



_norm("N26_compared_form", X.compared, "lower(trim(regexp_replace(replace(replace(text, '½', '1/2'), '¼', '1/4'), '\\s+', ' ', 'g')))")
_norm("N27_html_escaped", X.html_escaped, "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')")
_norm_art("N29_all_fixes", X.fixed, "regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(replace(replace(" + _LINK.replace("text", "content") + ", chr(92) || '(', '('), chr(92) || ')', ')'), '(?i)(\\S)\\n+\\s*(\\(See (?:Note|also)[^)]*\\))', '\\1 \\2', 'g'), '<sup>2</sup>', '²'), '\\*\\*([^*\\n]+)\\*\\*', '\\1', 'g'), '\\*([^*\\n]+)\\*', '\\1', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")
add("N02_newlines_collapsed", lambda s, d: B(s, d, "documents").select("doc_id", F.sha2(X.newlines_collapsed(F.replace(F.col("text"), F.lit(". "), F.lit("\n\n\n"))), 256).alias("sha")), "SELECT doc_id, sha256(regexp_replace(replace(text, '. ', chr(10) || chr(10) || chr(10)), '\\n{3,}', chr(10) || chr(10), 'g')) AS sha FROM documents")
add("N22_tags_removed", lambda s, d: B(s, d, "pages").select("page_id", F.sha2(X.tags_removed(F.col("html")), 256).alias("sha")), "SELECT page_id, sha256(regexp_replace(html, '<[^>]*>', '', 'g')) AS sha FROM pages")
add("N25_cells_cleaned", lambda s, d: M(s, d, "cells").select("table_id", "row", "col", X.cell_cleaned(F.col("cell")).alias("cell")), "SELECT table_id, row, col, nullif(trim(regexp_replace(cell, '\\s+', ' ', 'g')), '') AS cell FROM cells", "cells")

# ---- grids
add("G01_pipe_rows", lambda s, d: G.pipe_rows(M(s, d, "lines")), "SELECT doc, line, 'A;B;C' AS cells FROM lines WHERE text = '| A | B | C |'", "lines")
add("G03_pipe_blocks", lambda s, d: G.pipe_blocks(M(s, d, "lines")), ", p AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page, line, text) AS pos FROM lines), q AS (SELECT *, pos - row_number() OVER (PARTITION BY doc ORDER BY page, line, text) AS run FROM p WHERE starts_with(trim(text), '|')) SELECT doc, min(line) AS first_line, count(*) AS n FROM q GROUP BY doc, run", "lines")
add("G05_header_rows", lambda s, d: G.header_rows(M(s, d, "cells")),
    ", r AS (SELECT table_id, row, sum(CASE WHEN trim(coalesce(cell, '')) <> '' THEN 1 ELSE 0 END) AS n, sum(CASE WHEN trim(coalesce(cell, '')) <> '' AND regexp_matches(cell, '^[0-9]+$') THEN 1 ELSE 0 END) AS k FROM cells GROUP BY table_id, row), g AS (SELECT table_id, count(*) AS rows, min(CASE WHEN n > 0 AND k * 10 > n * 4 AND row <= 5 THEN row END) AS f FROM r GROUP BY table_id) SELECT table_id, CASE WHEN rows = 1 THEN 1 ELSE coalesce(greatest(1, f - 1), greatest(1, least(5, rows - 1))) END AS header_rows FROM g", "cells")
add("G08_html_tables", lambda s, d: G.html_tables(M(s, d, "cells")).select("table_id", F.sha2("html", 256).alias("sha")),
    ", c AS (SELECT table_id, row, string_agg(concat('<', CASE WHEN row = 1 OR col = 1 THEN 'th' ELSE 'td' END, '>', trim(coalesce(cell, '')), '</', CASE WHEN row = 1 OR col = 1 THEN 'th' ELSE 'td' END, '>'), '' ORDER BY col) AS t FROM cells GROUP BY table_id, row) SELECT table_id, sha256(concat('<table>', string_agg(concat('<tr>', t, '</tr>'), '' ORDER BY row), '</table>')) AS sha FROM c GROUP BY table_id", "cells")
add("G09_cell_comparison", lambda s, d: G.compared_cells(W.fill_down(M(s, d, "cells")), M(s, d, "cells")),
    f", f AS (SELECT table_id, row, col, lower(trim(coalesce({_DOWN}, ''))) AS a, lower(trim(coalesce(cell, ''))) AS b FROM cells) SELECT table_id, round(sum(CASE WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN 0.5 ELSE 0.0 END) / count(*), 6) AS accuracy FROM f GROUP BY table_id", "cells")

add("G11_quality_score", lambda s, d: G.shapes(M(s, d, "cells")).join(G.blank_percent(M(s, d, "cells")), "table_id").select("table_id", G.quality_score(F.col("rows"), F.col("cols"), F.lit(4), F.lit(3), F.col("blank_percent")).alias("score")),
    ", f AS (SELECT table_id, max(row) AS r, max(col) AS c, round(avg(CASE WHEN trim(coalesce(cell, '')) = '' THEN 100.0 ELSE 0.0 END), 1) AS p FROM cells GROUP BY table_id) SELECT table_id, round(greatest(0.0, 20.0 - 5 * abs(r - 4)) + greatest(0.0, 20.0 - 5 * abs(c - 3)) + greatest(0.0, 60.0 - p), 6) AS score FROM f", "cells")
add("G13_grid_validation", lambda s, d: G.validated(M(s, d, "cells"), 6), ", c AS (SELECT table_id, col, sum(CASE WHEN trim(coalesce(cell, '')) <> '' THEN 1 ELSE 0 END) AS f, sum(CASE WHEN length(cell) > 6 THEN 1 ELSE 0 END) AS l FROM cells GROUP BY table_id, col) SELECT table_id, CAST(sum(CASE WHEN f = 0 THEN 1 ELSE 0 END) AS BIGINT) AS empty_columns, CAST(sum(l) AS BIGINT) AS long_cells FROM c GROUP BY table_id", "cells")
add("G17_two_sides", lambda s, d: B(s, d, "events").groupBy("user_id", F.when(F.col("value") < 25, "left").otherwise("right").alias("side")).agg(F.count("*").alias("n")), "SELECT user_id, CASE WHEN value < 25 THEN 'left' ELSE 'right' END AS side, count(*) AS n FROM events GROUP BY 1, 2")

# ---- quality
_RULES_SQL = """, c AS (SELECT doc AS id, content FROM art), f AS (
  SELECT id, 'ERROR' AS level, 'RAW_BOLD' AS rule FROM c WHERE regexp_matches(content, '(?m)^\\*\\*[A-Z].*\\*\\*$') UNION ALL
  SELECT id, 'WARN', 'PDF_HEADER_LEAK' FROM c WHERE regexp_matches(content, '[0-9]{4}\\s+Building Code') UNION ALL
  SELECT id, 'WARN', 'RAW_HTML_TAG' FROM c WHERE regexp_matches(content, '(?i)<sup>[^<]*</sup>') UNION ALL
  SELECT id, 'WARN', 'SEPARATED_CONTINUATION' FROM c WHERE regexp_matches(content, '\\([a-z]\\)[^\\n]*[,;]\\s*\\n[a-z]') UNION ALL
  SELECT id, 'WARN', 'SEPARATED_SEE_NOTE' FROM c WHERE regexp_matches(content, '(?i)\\n\\s*\\(See\\s+Note\\s+[A-Z]?-?[0-9]') UNION ALL
  SELECT id, 'ERROR', 'BAD_CLAUSE_NUMBER' FROM c WHERE regexp_matches(content, '(?m)^- \\([0-9]+\\.[0-9]+\\)') UNION ALL
  SELECT id, 'WARN', 'INLINE_ITALIC' FROM c WHERE contains(content, 'the *old* rule') UNION ALL
  SELECT id, 'ERROR', 'MISSING_SPACE' FROM c WHERE regexp_matches(content, '[0-9]\\.[0-9]+\\.?[0-9]*[A-Z][a-z]') UNION ALL
  SELECT id, 'ERROR', 'MD_LINK' FROM c WHERE contains(content, '](#page-') UNION ALL
  SELECT id, 'ERROR', 'ESCAPED_PAREN' FROM c WHERE contains(content, chr(92) || '(x'))"""
_found = lambda s, d: V.findings(art(s, d).select(F.col("doc").alias("id"), "content"))
add("V02_findings", _found, _RULES_SQL + " SELECT id, level, rule FROM f", "art")
_MARKED_RULES = [
    ("RAW_MARKDOWN_HEADING", "ERROR", "len([x FOR x IN l IF regexp_matches(x, '^#{2,4}\\s+') AND NOT regexp_matches(x, '^#{2,4}\\s+Table\\s+[0-9]')]) > 0"),
    ("RAW_ITALIC", "WARN", "len([x FOR x IN l IF starts_with(x, '*Italic') OR starts_with(x, '*Forming')]) > 0 AND len([x FOR x IN l IF starts_with(x, '**')]) = 0"),
    ("FLAT_TABLE", "ERROR", "contains(content, 'C.A. Number') AND NOT contains(content, '<table>')"),
    ("FLAT_HI_TABLE", "WARN", "contains(content, 'Small Medium ') AND NOT contains(content, '<table>')"),
    ("TABLE_MISMATCH", "WARN", "len(regexp_extract_all(content, 'Table 9\\.[0-9]+\\.[0-9]+-[A-C]')) > 2 + len(string_split(content, '<table')) - 1"),
    ("DASH_SEE_NOTE", "ERROR", "len([x FOR x IN l IF starts_with(x, '- (See Note')]) > 0"),
    ("ORPHAN_DASH_LINE", "WARN", "len([x FOR x IN l IF starts_with(x, '- ') AND NOT regexp_matches(x[3], '[(A-Za-z]')]) > 0"),
    ("INLINE_BOLD", "ERROR", "contains(content, 'but see (**')"),
]
add("V02_marked_findings", lambda s, d: V.findings(mart(s, d).select(F.col("doc").alias("id"), "content")).filter(F.col("rule").isin([r for r, _, _ in _MARKED_RULES])),
    ", c AS (SELECT doc AS id, content, string_split(content, chr(10)) AS l FROM mart) " + " UNION ALL ".join(f"SELECT id, '{level}' AS level, '{rule}' AS rule FROM c WHERE {test}" for rule, level, test in _MARKED_RULES), "mart")
add("V21_summary", lambda s, d: V.summary(_found(s, d)), _RULES_SQL + " SELECT rule, level, count(*) AS n, count(DISTINCT id) AS ids FROM f GROUP BY rule, level", "art")
_SQL["O04_most_issues"] = f"WITH art AS ({ARTICLES_SQL}) {_RULES_SQL} SELECT id, count(*) AS n FROM f GROUP BY id ORDER BY n DESC, id LIMIT 30"
add("V22_passes", lambda s, d: V.passes(_found(s, d)), _RULES_SQL + " SELECT id, bool_and(level <> 'ERROR') AS passes FROM f GROUP BY id", "art")
add("V01_empty_content", lambda s, d: M(s, d, "nodes").filter("type = 'subsection' AND coalesce(content, '') = ''").select("id"), "SELECT id FROM nodes WHERE type = 'subsection' AND coalesce(content, '') = ''", "nodes")
add("V08_short_content", lambda s, d: M(s, d, "nodes").filter((F.size(F.split("id", r"\.")) == 3) & (F.length("content") < 100) & (F.col("content") != "")).select("id"), "SELECT id FROM nodes WHERE len(string_split(id, '.')) = 3 AND length(content) < 100 AND content <> ''", "nodes")
add("V09_unbalanced_html", lambda s, d: V.unbalanced(B(s, d, "pages"), "p"), "SELECT * FROM (SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<p[\\s>]')) AS BIGINT) AS opened, CAST(len(regexp_extract_all(html, '(?i)</p>')) AS BIGINT) AS closed FROM pages) WHERE opened <> closed")

add("V27_dangling_references", lambda s, d: V.dangling(M(s, d, "refs").filter("target_type = 'article'").select("source_id", "target_id").distinct(), "target_id", B(s, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("id")), "id"), "SELECT DISTINCT source_id, target_id FROM refs WHERE target_type = 'article' AND target_id NOT IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'F')", "refs")
add("V28_misplaced_nodes", lambda s, d: V.misplaced(H.open_ancestors(M(s, d, "lines").withColumn("type", X.line_type(F.col("text")))).select("doc", "line", "type", X.line_type(F.col("parent")).alias("parent_type")), {"clause": ["article", "article_suffix", "article_0a", "sub_article"]}),
    f", t AS MATERIALIZED (SELECT doc, line, {LINE_TYPE_SQL} AS type FROM lines), h AS MATERIALIZED (SELECT *, max(CASE WHEN line = 0 THEN type END) OVER (PARTITION BY doc) AS parent_type FROM t) SELECT doc, line, type, parent_type FROM h WHERE type = 'clause' AND parent_type IN ('subsection', 'alt_subsection')", "lines")
add("V33_rendered_pages", lambda s, d: V.rendered(B(s, d, "pages")), "SELECT page_id, CASE WHEN NOT regexp_matches(html, '(?i)<title>') OR length(html) < 500 THEN 'FAIL' WHEN NOT regexp_matches(html, '(?i)<h[12][ >]') THEN 'WARN' ELSE 'PASS' END AS status FROM pages")
add("V34_null_counts", lambda s, d: M(s, d, "tables").agg(F.count_if(F.col("parent_id").isNull()).alias("no_parent"), F.count_if(F.col("source").isNull()).alias("no_source"), F.count("*").alias("n")), "SELECT count(*) FILTER (WHERE parent_id IS NULL) AS no_parent, count(*) FILTER (WHERE source IS NULL) AS no_source, count(*) AS n FROM tables", "tables")

# ---- lines, sources, write modes
add("S04_lines", lambda s, d: doc_lines(s, d).groupBy("doc_id").agg(F.count("*").alias("lines"), F.max("pos").cast("long").alias("last"), F.max(F.length("line")).alias("longest")), f"SELECT doc_id, count(*) AS lines, CAST(max(pos) AS BIGINT) AS last, CAST(max(length(line)) AS INT) AS longest FROM ({DOC_LINES}) GROUP BY doc_id")
add("S10_priority_source", lambda s, d: W.first_of(B(s, d, "documents").select("doc_id", F.lit(2).alias("prio"), F.col("lang").alias("v")).unionByName(B(s, d, "labels").select("doc_id", F.lit(1).alias("prio"), F.col("quality").cast("string").alias("v"))), ["doc_id"], ["prio"]), "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 2 ELSE 1 END AS prio, coalesce(CAST(quality AS VARCHAR), lang) AS v FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
add("S11_detected_pages", lambda s, d: M(s, d, "lines").join(M(s, d, "lines").filter(F.col("text").startswith("|")).select("doc", "page").distinct(), ["doc", "page"], "left_semi").groupBy("doc", "page").agg(F.count("*").alias("n")), "SELECT doc, page, count(*) AS n FROM lines WHERE (doc, page) IN (SELECT doc, page FROM lines WHERE starts_with(text, '|')) GROUP BY doc, page", "lines")
add("S17_resume", lambda s, d: B(s, d, "documents").select("doc_id").join(B(s, d, "labels").filter("toxic = 0").select("doc_id"), "doc_id", "left_anti"), "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)")


def _old_new(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Old rows are those whose status is not P, new ones those whose status is not F: some keys are in both, some in one."""
    o = B(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey", F.col("o_orderstatus").alias("status"))
    return o.filter("status <> 'P'").drop("status"), o.filter("status <> 'F'").drop("status").withColumn("o_orderstatus", F.lit("new"))


add("S20_part_replaced", lambda s, d: R.part_replaced(*_old_new(s, d), "o_custkey"), "WITH n AS (SELECT o_orderkey, 'new' AS o_orderstatus, o_custkey FROM orders WHERE o_orderstatus <> 'F') SELECT o_orderkey, o_orderstatus, o_custkey FROM orders WHERE o_orderstatus <> 'P' AND o_custkey NOT IN (SELECT o_custkey FROM n) UNION ALL SELECT * FROM n")
add("S21_merged", lambda s, d: R.merged(*_old_new(s, d), "o_orderkey"), "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN 'new' ELSE o_orderstatus END AS o_orderstatus, o_custkey, CASE o_orderstatus WHEN 'P' THEN 'insert' WHEN 'F' THEN 'keep' ELSE 'update' END AS action FROM orders")
add("S22_upserted", lambda s, d: R.upserted(*_old_new(s, d), "o_orderkey"), "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN 'new' ELSE o_orderstatus END AS o_orderstatus, o_custkey FROM orders")
add("S23_inserted_if_absent", lambda s, d: R.inserted_if_absent(*_old_new(s, d), "o_orderkey"), "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'new' ELSE o_orderstatus END AS o_orderstatus, o_custkey FROM orders")
add("S24_null_parent", lambda s, d: R.null_parent_fallback(B(s, d, "documents").select("doc_id"), B(s, d, "labels").filter("quality = 1").select("doc_id"), "doc_id", "doc_id"), "SELECT l.doc_id FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 1) l ON l.doc_id = d.doc_id")
add("A23_action_counts", lambda s, d: R.merged(*_old_new(s, d), "o_orderkey").groupBy("action").agg(F.count("*").alias("n")), "SELECT CASE o_orderstatus WHEN 'P' THEN 'insert' WHEN 'F' THEN 'keep' ELSE 'update' END AS action, count(*) AS n FROM orders GROUP BY 1")
