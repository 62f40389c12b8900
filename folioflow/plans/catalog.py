"""The registered queries: each binds operators to the relations and has an independent SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import grids as G
from folioflow.operators import ordered as W
from folioflow.operators import quality as V
from folioflow.operators import relational as R
from folioflow.operators import search as K
from folioflow.operators import tree as H
from folioflow.sources.relations import ARTICLES_SQL, MARKED_ARTICLES_SQL, MODEL, articles, base, dealt, model, pieces, tree_pieces

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

B, M = base, model
#: Relations whose lines are joined to one content for each document.
JOINED = {"art": ARTICLES_SQL, "mart": MARKED_ARTICLES_SQL}


def add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None, *models: str) -> None:
    """Registers a query; sql may name the relations of `models` (and art, mart: articles), which become its first CTEs."""
    QUERIES[name] = run
    if sql:
        ctes = [f"{m} AS ({JOINED.get(m) or MODEL[m]})" for m in models]
        SQL[name] = f"WITH {', '.join(ctes)} {sql}" if ctes else sql


def docs(s: SparkSession, d: str) -> DataFrame:
    """documents as search rows: id, title, content."""
    return B(s, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), F.col("text").alias("content"))


def art(s: SparkSession, d: str) -> DataFrame:
    return articles(M(s, d, "lines"))


def mart(s: SparkSession, d: str) -> DataFrame:
    return articles(M(s, d, "marked"))


def doc_lines(s: SparkSession, d: str) -> DataFrame:
    return B(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


DOCS = "SELECT CAST(doc_id AS VARCHAR) AS id, source AS title, text AS content FROM documents"
DOC_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents"

#: The type of a line of the model, from how the lines are made rather than from their patterns.
LINE_TYPE_SQL = """CASE WHEN text = '' OR regexp_matches(text, '^[0-9]+$') OR contains(text, 'Building Code') THEN NULL
  WHEN line = 0 AND doc % 13 <> 0 THEN CASE doc % 8 WHEN 0 THEN 'article_suffix' WHEN 1 THEN 'alt_subsection' WHEN 2 THEN 'subsection' WHEN 3 THEN 'article_0a' WHEN 4 THEN 'sub_article' ELSE 'article' END
  WHEN regexp_matches(text, '^[(][0-9]+[)] +[A-Z]') THEN 'clause' WHEN regexp_matches(text, '^[(][a-z][)] +.') THEN 'subclause' WHEN regexp_matches(text, '^[(][ivx]+[)] +.') THEN 'subsubclause' END"""

# ---- search
_Q = "the src1 7"


def _score_sql(query: str) -> str:
    parts = []
    for t in K.terms_of(query):
        parts.append(f"CASE WHEN lower(id) = '{t}' THEN 100 WHEN contains(lower(id), '{t}') THEN 50 ELSE 0 END + CASE WHEN contains(lower(title), '{t}') THEN 30 ELSE 0 END + CASE WHEN contains(lower(content), '{t}') THEN 10 + least(len(regexp_extract_all(lower(content), '{t}')), 5) * 2 ELSE 0 END")
    return " + ".join(parts)


add("K01_ranked_search", lambda s, d: K.ranked(docs(s, d), _Q), f"SELECT id, score FROM (SELECT id, CAST({_score_sql(_Q)} AS BIGINT) AS score FROM ({DOCS})) WHERE score > 0 ORDER BY score DESC, id LIMIT 50")
add("K02_all_terms", lambda s, d: K.all_terms(docs(s, d), "the and"), f"SELECT id, title, substring(content, 1, 500) AS content, CASE WHEN contains(lower(title), 'the and') THEN -10 ELSE 0 END AS rank FROM ({DOCS}) WHERE contains(lower(concat_ws(' ', title, content)), 'the') AND contains(lower(concat_ws(' ', title, content)), 'and') ORDER BY rank, id LIMIT 50")
add("K03_bm25", lambda s, d: K.bm25(docs(s, d), "the and on"),
    f"""WITH w AS (SELECT id, [x for x in string_split_regex(lower(content), '[^a-z0-9]+') if x <> ''] AS w FROM ({DOCS})), sz AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM w),
    tf AS (SELECT id, term, count(*) AS tf, first(n) AS n FROM (SELECT id, len(w) AS n, unnest([x for x in w if x IN ('the', 'and', 'on')]) AS term FROM w) GROUP BY id, term),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
    SELECT id, score FROM (SELECT id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score, count(*) AS hit FROM tf JOIN df USING (term) CROSS JOIN sz GROUP BY id) WHERE hit = 3 ORDER BY score DESC, id LIMIT 20""")
add("K05_snippet", lambda s, d: docs(s, d).select("id", K.snippet(F.col("content"), "worth ction").alias("snippet")),
    f"""SELECT id, CASE WHEN content = '' THEN '' WHEN m < 0 THEN concat(substring(content, 1, 200), CASE WHEN length(content) > 200 THEN '...' ELSE '' END)
    ELSE concat(CASE WHEN m > 50 THEN '...' ELSE '' END, substring(content, greatest(0, m - 50) + 1, least(length(content), m + 150) - greatest(0, m - 50)), CASE WHEN m + 150 < length(content) THEN '...' ELSE '' END) END AS snippet
    FROM (SELECT id, content, coalesce(least(nullif(strpos(lower(content), 'worth'), 0), nullif(strpos(lower(content), 'ction'), 0)) - 1, -1) AS m FROM ({DOCS}))""")
add("K06_highlight", lambda s, d: docs(s, d).select("id", F.sha2(K.highlighted(F.col("content"), "the and"), 256).alias("sha")),
    f"SELECT id, sha256(regexp_replace(regexp_replace(content, '(?i)(the)', '**\\1**', 'g'), '(?i)(and)', '**\\1**', 'g')) AS sha FROM ({DOCS})")
add("K07_highlight_segments", lambda s, d: docs(s, d).select("id", K.segments(F.col("content"), "ing").cast("long").alias("segments")), f"SELECT id, CAST(2 * len(regexp_extract_all(content, '(?i)ing')) + 1 AS BIGINT) AS segments FROM ({DOCS})")
add("K10_postings", lambda s, d: K.postings(docs(s, d)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")),
    f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest([x for x in string_split_regex(lower(content), '[^a-z0-9]+') if x <> '']) AS term FROM ({DOCS})) GROUP BY id, term) GROUP BY term")
add("K12_page_locator", lambda s, d: M(s, d, "lines").filter(F.col("text").contains("Table 9.1") & F.col("text").contains("conforms")).groupBy("doc").agg(F.min("page").alias("page")), "SELECT doc, min(page) AS page FROM lines WHERE contains(text, 'Table 9.1') AND contains(text, 'conforms') GROUP BY doc", "lines")

# ---- lookups and filters
add("F01_node_by_id", lambda s, d: H.node_by_id(M(s, d, "nodes"), "1.1"), "SELECT * FROM nodes WHERE id = '1.1' AND type IN ('part', 'section', 'subsection')", "nodes")
add("F02_part_pruning", lambda s, d: M(s, d, "nodes").filter("part = 3").groupBy("type").agg(F.count("*").alias("n")), "SELECT type, count(*) AS n FROM nodes WHERE split_part(id, '.', 1) = '3' GROUP BY type", "nodes")
add("F03_nodes_by_type", lambda s, d: H.nodes_by_type(M(s, d, "nodes"), "section"), "SELECT * FROM nodes WHERE type = 'section' ORDER BY seq, id", "nodes")
add("F04_id_prefix", lambda s, d: M(s, d, "nodes").filter(F.col("id").startswith("4.")).select("id", "type"), "SELECT id, type FROM nodes WHERE id LIKE '4.%'", "nodes")
add("F05_combined_filter", lambda s, d: M(s, d, "nodes").filter(F.col("type").isin("subsection", "article") & (F.col("id").startswith("1.") | F.col("id").startswith("2.")) & F.col("content").isNotNull()).select("id", "content"), "SELECT id, content FROM nodes WHERE type IN ('subsection', 'article') AND (id LIKE '1.%' OR id LIKE '2.%') AND content IS NOT NULL", "nodes")
add("F06_contains_not", lambda s, d: art(s, d).filter(F.col("content").ilike("%|%|%") & ~F.col("content").ilike("%<sup%")).select("doc"), "SELECT doc FROM art WHERE content ILIKE '%|%|%' AND content NOT ILIKE '%<sup%'", "art")
add("F07_two_level_parent", lambda s, d: M(s, d, "nodes").filter(F.size(F.split("parent_id", r"\.")) == 2).groupBy("parent_id").agg(F.count("*").alias("n")), "SELECT parent_id, count(*) AS n FROM nodes WHERE parent_id LIKE '%.%' AND parent_id NOT LIKE '%.%.%' GROUP BY parent_id", "nodes")
add("F08_missing_html", lambda s, d: M(s, d, "tables").filter("html IS NULL").select("id", "title"), "SELECT id, title FROM tables WHERE html IS NULL", "tables")
add("F09_tag_count", lambda s, d: B(s, d, "pages").select("page_id", ((F.length("html") - F.length(F.replace(F.col("html"), F.lit("<p>"), F.lit("")))) / 3).cast("long").alias("n")), "SELECT page_id, (length(html) - length(replace(html, '<p>', ''))) // 3 AS n FROM pages")
add("F10_substring", lambda s, d: docs(s, d).select("id", F.substring("content", 1, 500).alias("head")), f"SELECT id, substring(content, 1, 500) AS head FROM ({DOCS})")
add("F11_search_projection", lambda s, d: M(s, d, "nodes").filter("type = 'article'").select("id", F.substring("content", 1, 1000).alias("content"), F.concat(F.lit("/code/"), F.regexp_replace("id", r"\.", "-")).alias("path")), "SELECT id, substring(content, 1, 1000) AS content, concat('/code/', replace(id, '.', '-')) AS path FROM nodes WHERE type = 'article'", "nodes")
add("F12_alternative_ids", lambda s, d: M(s, d, "lines").filter("line = 0").select("doc", F.regexp_extract("text", r"^(\d+\.\d+\.\d+[A-Z])\. +[A-Z].+$", 1).alias("id")).filter("id <> ''"), "SELECT doc, id FROM (SELECT doc, regexp_extract(text, '^([0-9]+[.][0-9]+[.][0-9]+[A-Z])[.] +[A-Z].+$', 1) AS id FROM lines WHERE line = 0) WHERE id <> ''", "lines")
add("F13_sequence_from_id", lambda s, d: M(s, d, "nodes").filter("type IN ('section', 'subsection')").select("id", F.round(F.regexp_extract("id", r"^(\d+(\.\d+)?)", 1).cast("double") * 100, 4).alias("seq")), "SELECT id, round(CAST(regexp_extract(id, '^([0-9]+([.][0-9]+)?)', 1) AS DOUBLE) * 100, 4) AS seq FROM nodes WHERE type IN ('section', 'subsection')", "nodes")
add("F14_sections_of_part", lambda s, d: M(s, d, "nodes").filter("type = 'section' AND part = 2").select("id", "title", (F.row_number().over(W.Window.partitionBy("part").orderBy("seq")) - 1).alias("seq")), "SELECT id, title, row_number() OVER (ORDER BY seq) - 1 AS seq FROM nodes WHERE type = 'section' AND part = 2", "nodes")


def optional_filters(rows: DataFrame, **wanted: object) -> DataFrame:
    """One equality for each argument that is given."""
    for column, value in wanted.items():
        rows = rows if value is None else rows.filter(F.col(column) == value)
    return rows


add("F15_optional_filters", lambda s, d: optional_filters(M(s, d, "nodes"), part=1, type="article", page=None).select("id", "page"), "SELECT id, page FROM nodes WHERE part = 1 AND type = 'article'", "nodes")
add("F16_missing_node", lambda s, d: H.node_by_id(M(s, d, "nodes"), "77.1"), "SELECT * FROM nodes WHERE id = '77.1'", "nodes")

# ---- joins
add("J01_tables_join_nodes", lambda s, d: M(s, d, "tables").select(F.col("id").alias("table_id"), F.col("parent_id").cast("long").alias("k")).join(B(s, d, "orders"), F.col("k") == F.col("o_orderkey")).select("table_id", "k", "o_orderpriority"), "SELECT t.id AS table_id, o_orderkey AS k, o_orderpriority FROM tables t JOIN orders ON CAST(parent_id AS BIGINT) = o_orderkey", "tables")
add("J02_left_join_not_null", lambda s, d: B(s, d, "documents").select("doc_id").join(B(s, d, "labels"), "doc_id", "left").filter("quality IS NOT NULL").select("doc_id", "quality"), "SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL")
add("J03_referenced_tables", lambda s, d: M(s, d, "refs").filter("target_type = 'table'").join(M(s, d, "tables").select("id", "title"), F.col("target_id") == F.col("id")).select("source_id", "id", "title").distinct(), "SELECT DISTINCT source_id, t.id AS id, title FROM refs JOIN tables t ON target_id = t.id WHERE target_type = 'table'", "refs", "tables")
add("J04_reference_directions", lambda s, d: M(s, d, "refs").groupBy("target_id", "target_type").agg(F.count("*").alias("n_in"), F.countDistinct("source_id").alias("sources")), "SELECT target_id, target_type, count(*) AS n_in, count(DISTINCT source_id) AS sources FROM refs GROUP BY target_id, target_type", "refs")
add("J05_hits_join_rows", lambda s, d: K.bm25(docs(s, d), "the and", 10).join(B(s, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "lang"), "id"),
    f"""WITH w AS (SELECT id, [x for x in string_split_regex(lower(content), '[^a-z0-9]+') if x <> ''] AS w FROM ({DOCS})), sz AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM w),
    tf AS (SELECT id, term, count(*) AS tf, first(n) AS n FROM (SELECT id, len(w) AS n, unnest([x for x in w if x IN ('the', 'and')]) AS term FROM w) GROUP BY id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    top AS (SELECT id, score FROM (SELECT id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score, count(*) AS hit FROM tf JOIN df USING (term) CROSS JOIN sz GROUP BY id) WHERE hit = 2 ORDER BY score DESC, id LIMIT 10)
    SELECT id, score, lang FROM top JOIN documents ON CAST(doc_id AS VARCHAR) = id""")
add("J06_parent_fallback", lambda s, d: R.resolved_parent(M(s, d, "tables").select("id", "parent_id"), B(s, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("id")), F.col("parent_id"), F.regexp_extract("parent_id", r"^(\d)", 1)),
    "SELECT t.id, coalesce(a.k, b.k) AS parent_id FROM tables t LEFT JOIN (SELECT CAST(o_orderkey AS VARCHAR) AS k FROM orders WHERE o_orderstatus = 'F') a ON a.k = t.parent_id LEFT JOIN (SELECT CAST(o_orderkey AS VARCHAR) AS k FROM orders WHERE o_orderstatus = 'F') b ON b.k = regexp_extract(t.parent_id, '^([0-9])', 1)", "tables")
add("J07_existing_labels", lambda s, d: B(s, d, "documents").select("doc_id", "lang").join(B(s, d, "labels"), "doc_id", "left_semi"), "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
add("J07_unlabelled", lambda s, d: B(s, d, "documents").select("doc_id", "lang").join(B(s, d, "labels"), "doc_id", "left_anti"), "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
add("J08_missing_tables", lambda s, d: M(s, d, "refs").filter("target_type = 'table'").select("target_id").distinct().join(M(s, d, "tables").filter("html IS NOT NULL").select(F.col("id").alias("target_id")), "target_id", "left_anti"), "SELECT DISTINCT target_id FROM refs WHERE target_type = 'table' AND target_id NOT IN (SELECT id FROM tables WHERE html IS NOT NULL)", "refs", "tables")
add("J09_available_flag", lambda s, d: M(s, d, "refs").filter("target_type = 'table'").select("target_id").distinct().join(M(s, d, "tables").filter("html IS NOT NULL").select("id"), F.col("target_id") == F.col("id"), "left").select("target_id", F.col("id").isNotNull().alias("can_add")), "SELECT target_id, target_id IN (SELECT id FROM tables WHERE html IS NOT NULL) AS can_add FROM (SELECT DISTINCT target_id FROM refs WHERE target_type = 'table')", "refs", "tables")


add("J10_contained_phrases", lambda s, d: _contained(B(s, d, "documents"), B(s, d, "benchmark")), "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON b.text <> '' AND contains(d.text, b.text)")


#: Characters of a text whose places are looked at together.
BLOCK = 256
#: Heads of phrases that are sent to all tasks; more of them are joined by merge.
BROADCAST_HEADS = 100_000


def _contained(documents: DataFrame, phrases: DataFrame, size: int = 24) -> DataFrame:
    """doc_id, item_id where a document holds a phrase: an equi-join on the phrase's first characters, then the whole test.

    Positions of a document that start no phrase end at the join; the phrases' heads are what is matched, not all pairs. A
    phrase of fewer than size characters is its own head. The driver gets the heads' lengths and first characters. Rows
    without a doc_id and repeated ids are told apart by their texts; empty phrases are not looked for.
    """
    heads = phrases.filter("text <> ''").select("item_id", F.col("text").alias("phrase"), F.substring("text", 1, size).alias("head"))
    sizes = sorted(r[0] for r in heads.select(F.length("head")).distinct().collect()) or [size]
    first = [r[0] for r in heads.select(F.substring("head", 1, 1)).distinct().collect()]
    rows = documents.select("doc_id", "text", F.xxhash64("text").alias("h"))
    # blocks that overlap by a head's length: a place in a block is found at once, one in a long text by counting up to it
    block = lambda k: F.substring("text", k * BLOCK + 1, F.lit(BLOCK + max(sizes) - 1))
    blocks = rows.filter("text <> ''").select("doc_id", "h", F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / BLOCK).cast("int")), block)).alias("block"))
    places = F.sequence(F.lit(1), F.least(F.lit(BLOCK), F.length("block")))
    starts = F.filter(places, lambda i: F.substring("block", i, F.lit(1)).isin(first))
    of_size = lambda n: F.transform(starts, lambda i: F.substring("block", i, F.lit(n)))
    spots = F.flatten(F.array(*map(of_size, sizes)))
    spots = blocks.select("doc_id", "h", F.explode(F.array_distinct(spots)).alias("head"))
    known = heads.select("head").distinct()
    few = known.limit(BROADCAST_HEADS + 1).count() <= BROADCAST_HEADS
    hits = spots.join(F.broadcast(known) if few else known.hint("merge"), "head", "left_semi").distinct().join(heads, "head").alias("x")
    rows = rows.alias("d")
    found = hits.join(rows, (F.col("x.h") == F.col("d.h")) & F.col("x.doc_id").eqNullSafe(F.col("d.doc_id"))).filter(F.col("d.text").contains(F.col("phrase")))
    return found.select("d.doc_id", "item_id")


_TERMS = ["the", "tion", "there", "her", "ou", "and the"]
add("J15_definition_lookup", lambda s, d: docs(s, d).select("id", F.explode(X.terms_in(F.col("content"), _TERMS)).alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("id").alias("docs")),
    f"SELECT term, count(*) AS n, count(DISTINCT id) AS docs FROM (SELECT id, lower(unnest(regexp_extract_all(content, '(?i)\\b(and the|there|tion|her|the|ou)\\b', 1))) AS term FROM (SELECT id, regexp_replace(content, '[^ -~\\n]', '#', 'g') AS content FROM ({DOCS}))) GROUP BY term")
add("J16_expected_actual", lambda s, d: B(s, d, "nation").select("n_nationkey", (F.col("n_nationkey") * 2 + 40).alias("expected")).join(B(s, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("actual")), "n_nationkey", "left").select("n_nationkey", "expected", F.coalesce("actual", F.lit(0)).alias("actual"), (F.coalesce("actual", F.lit(0)) >= F.col("expected")).alias("ok")),
    "SELECT n_nationkey, n_nationkey * 2 + 40 AS expected, coalesce(a, 0) AS actual, coalesce(a, 0) >= n_nationkey * 2 + 40 AS ok FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS a FROM customer GROUP BY c_nationkey) ON c_nationkey = n_nationkey")

# ---- tree
add("H01_children", lambda s, d: H.children(M(s, d, "nodes"), "2.2").select("id", "seq"), "SELECT id, seq FROM nodes WHERE parent_id = '2.2' ORDER BY seq, id", "nodes")
add("H02_breadcrumb", lambda s, d: H.breadcrumbs(M(s, d, "nodes")),
    "SELECT id, array_to_string([array_to_string(p[1 : i], '.') FOR i IN range(1, len(p) + 1)], '/') AS path, CAST(len(p) AS INT) AS depth FROM (SELECT id, string_split(id, '.') AS p FROM nodes)", "nodes")
add("H02_breadcrumb_by_parent", lambda s, d: H.breadcrumbs_by_parent(M(s, d, "nodes").filter("type IN ('part', 'section', 'subsection')")),
    ", n AS MATERIALIZED (SELECT id, parent_id FROM nodes WHERE type IN ('part', 'section', 'subsection')) SELECT a.id, concat_ws('/', c.id, b.id, a.id) AS path, CAST(1 + (b.id IS NOT NULL)::INT + (c.id IS NOT NULL)::INT AS INT) AS depth FROM n a LEFT JOIN n b ON a.parent_id = b.id LEFT JOIN n c ON b.parent_id = c.id", "nodes")
_BELOW = f"WITH RECURSIVE nodes AS MATERIALIZED ({MODEL['nodes']}), t AS (SELECT id, type, 0 AS depth FROM nodes WHERE id = '1.1' UNION ALL SELECT n.id, n.type, t.depth + 1 FROM nodes n JOIN t ON n.parent_id = t.id)"
add("H03_subtree", lambda s, d: H.subtree_by_prefix(M(s, d, "nodes"), "1.1").select("id", "type"), f"{_BELOW} SELECT id, type FROM t")
add("H04_depth_tagged", lambda s, d: H.subtree(M(s, d, "nodes"), "1.1"), f"{_BELOW} SELECT id, depth FROM t")
add("H05_parent_from_id", lambda s, d: M(s, d, "nodes").select("id", H.prefix_parent(F.col("id")).alias("parent")), "SELECT id, CASE WHEN contains(id, '.') THEN regexp_replace(id, '[.][^.]*$', '') END AS parent FROM nodes", "nodes")
add("H06_open_ancestor", lambda s, d: H.open_ancestors(M(s, d, "lines").withColumn("type", X.line_type(F.col("text")))).filter("type IS NOT NULL"),
    f", t AS MATERIALIZED (SELECT doc, page, line, text, {LINE_TYPE_SQL} AS type FROM lines), h AS MATERIALIZED (SELECT doc, text, type FROM t WHERE line = 0) SELECT t.doc, t.line, t.type, CASE WHEN t.line > 0 AND h.type IS NOT NULL THEN h.text END AS parent FROM t LEFT JOIN h ON t.doc = h.doc WHERE t.type IS NOT NULL", "lines")
add("H07_child_sequence", lambda s, d: H.sequence_numbers(M(s, d, "nodes"), tree_pieces(s, d)), "SELECT id, parent_id, row_number() OVER (PARTITION BY coalesce(parent_id, '__root__') ORDER BY seq, id) AS seq FROM nodes", "nodes")
add("H09_children_lists", lambda s, d: H.children_lists(M(s, d, "nodes")), "SELECT parent_id AS id, string_agg(id, ',' ORDER BY seq, id) AS children, count(*) AS n_children FROM nodes WHERE parent_id IS NOT NULL GROUP BY parent_id", "nodes")
add("H10_flatten_nested", lambda s, d: H.flattened(H.nested(M(s, d, "nodes"))), "SELECT id, type, parent_id, title, CAST(row_number() OVER (PARTITION BY parent_id ORDER BY seq) AS INT) AS seq FROM nodes WHERE type IN ('section', 'subsection')", "nodes")
add("H11_table_of_contents", lambda s, d: H.toc(M(s, d, "nodes")), "SELECT a.part, a.id, a.title, coalesce(string_agg(concat(b.id, ':', b.title), '|' ORDER BY b.seq), '') AS children FROM nodes a LEFT JOIN nodes b ON b.parent_id = a.id AND b.type = 'subsection' WHERE a.type = 'section' GROUP BY a.part, a.id, a.title", "nodes")
add("H12_part_roll_up", lambda s, d: H.part_roll_up(M(s, d, "nodes")).select("part", F.array_join("k", ".").alias("k"), F.length("block").alias("n"), F.sha2("block", 256).alias("sha")),
    "SELECT part, id AS k, CAST(length(block) AS INT) AS n, sha256(block) AS sha FROM (SELECT part, id, concat('[', upper(type), ':', id, ':', coalesce(title, ''), ']', CASE WHEN type = 'subsection' AND content <> '' THEN chr(10) || chr(10) || content ELSE '' END) AS block FROM nodes WHERE type IN ('section', 'subsection'))", "nodes")
add("H13_section_page", lambda s, d: H.page_roll_up(M(s, d, "nodes")).select("id", F.sha2("content", 256).alias("sha")), "SELECT u.parent_id AS id, sha256(string_agg(coalesce(nullif(u.content, ''), g.titles, ''), chr(10) ORDER BY u.seq)) AS sha FROM nodes u LEFT JOIN (SELECT parent_id, string_agg(title, ', ' ORDER BY seq) AS titles FROM nodes WHERE type = 'article' GROUP BY parent_id) g ON g.parent_id = u.id WHERE u.type = 'subsection' GROUP BY u.parent_id", "nodes")
add("H14_clause_roll_up", lambda s, d: H.clause_roll_up(M(s, d, "nodes")), "SELECT parent_id AS id, string_agg(concat('(', seq, ') ', content), chr(10) ORDER BY seq) AS content FROM nodes WHERE type = 'clause' AND content <> '' GROUP BY parent_id", "nodes")
add("H14_conversation_roll_up", lambda s, d: B(s, d, "conversations").groupBy("conv_id").agg(F.sha2(H.joined(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("text"))), "\n"), 256).alias("sha")), "SELECT conv_id, sha256(string_agg(concat_ws(': ', role, text), chr(10) ORDER BY turn, concat_ws(': ', role, text))) AS sha FROM conversations GROUP BY conv_id")
add("H15_node_walk", lambda s, d: V.findings(M(s, d, "nodes").filter("type IN ('section', 'subsection', 'article')").select("id", "content")).groupBy("rule").agg(F.count("*").alias("n")), "SELECT 'EMPTY' AS rule, count(*) AS n FROM nodes WHERE type IN ('section', 'subsection', 'article') AND coalesce(content, '') = ''", "nodes")
add("H17_printed_tree", lambda s, d: H.printed(M(s, d, "nodes")), "SELECT id, repeat('  ', len(string_split(id, '.')) - 1) || id || ' [' || type || '] ' || CASE WHEN title <> '' THEN title WHEN content <> '' THEN left(content, 30) || '...' ELSE '' END AS line FROM nodes", "nodes")
add("H18_prefix_hierarchy", lambda s, d: M(s, d, "nodes").groupBy(H.prefix_parent(F.col("id")).alias("parent")).agg(F.count("*").alias("n")), "SELECT CASE WHEN contains(id, '.') THEN regexp_replace(id, '[.][^.]*$', '') END AS parent, count(*) AS n FROM nodes GROUP BY 1", "nodes")
add("H19_section_response", lambda s, d: H.section_view(M(s, d, "nodes"), M(s, d, "tables"), tree_pieces(s, d)), "SELECT a.id, a.type, a.title, coalesce(k.n, 0) AS n_children, k.f AS first_child, coalesce(t.n, 0) AS n_tables, replace(a.id, '.', '/') AS breadcrumb FROM nodes a LEFT JOIN (SELECT parent_id, count(*) AS n, min(id) AS f FROM nodes GROUP BY parent_id) k ON k.parent_id = a.id LEFT JOIN (SELECT parent_id, count(*) AS n FROM tables GROUP BY parent_id) t ON t.parent_id = a.id WHERE a.type IN ('section', 'subsection')", "nodes", "tables")
add("H20_next_sibling", lambda s, d: H.next_sibling(M(s, d, "nodes")), "SELECT id, lead(id) OVER (PARTITION BY parent_id ORDER BY seq) AS next_id FROM nodes WHERE type = 'subsection'", "nodes")

# ---- aggregates
add("A01_count_by_type", lambda s, d: M(s, d, "nodes").groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type"), "SELECT type, count(*) AS n FROM nodes GROUP BY type ORDER BY n DESC, type", "nodes")
add("A02_count_by_source", lambda s, d: M(s, d, "tables").groupBy(F.coalesce("source", F.lit("pending")).alias("source")).agg(F.count("*").alias("n")), "SELECT coalesce(source, 'pending') AS source, count(*) AS n FROM tables GROUP BY 1", "tables")
add("A03_rollup", lambda s, d: M(s, d, "nodes").rollup("part", "type").agg(F.count("*").alias("n")), "SELECT part, type, count(*) AS n FROM nodes GROUP BY ROLLUP (part, type)", "nodes")
add("A04_next_sequence", lambda s, d: M(s, d, "nodes").agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("next_seq")), "SELECT coalesce(max(seq), 0) + 1 AS next_seq FROM nodes", "nodes")
add("A05_counts", lambda s, d: dealt(M(s, d, "nodes").select("id"), pieces(B(s, d, "lineitem")), "id").agg(F.count("*").alias("nodes"), F.countDistinct("id").alias("ids")), "SELECT count(*) AS nodes, count(DISTINCT id) AS ids FROM nodes", "nodes")
add("A06_line_type_frequency", lambda s, d: M(s, d, "lines").groupBy(F.coalesce(X.line_type(F.col("text")), F.lit("other")).alias("type")).agg(F.count("*").alias("n")),
    "SELECT coalesce(CASE WHEN line = 0 AND doc % 13 <> 0 THEN CASE doc % 8 WHEN 0 THEN 'article_suffix' WHEN 1 THEN 'alt_subsection' WHEN 2 THEN 'subsection' WHEN 3 THEN 'article_0a' WHEN 4 THEN 'sub_article' ELSE 'article' END WHEN regexp_matches(text, '^[(][0-9]+[)] +[A-Z]') THEN 'clause' WHEN regexp_matches(text, '^[(][a-z][)] +.') THEN 'subclause' WHEN regexp_matches(text, '^[(][ivx]+[)] +.') THEN 'subsubclause' END, 'other') AS type, count(*) AS n FROM lines GROUP BY 1", "lines")
_SCREEN = lambda s, d: V.screened(art(s, d).select(F.col("doc").alias("id"), F.lit("t").alias("title"), "content"))
#: What the screening of an article (id, content) finds, issue by issue; the titles are all alike.
_SCREENED = """, c AS (SELECT doc AS id, content, trim(content, chr(9) || chr(10) || chr(13) || ' ') AS t FROM art),
  nums AS (SELECT id, CAST(unnest(x) AS BIGINT) AS v, generate_subscripts(x, 1) AS i FROM (SELECT id, regexp_extract_all(content, '[(]([0-9]+)[)]', 1) AS x FROM c)),
  seen AS (SELECT id, v, min(i) AS i FROM nums GROUP BY id, v),
  steps AS (SELECT id, i, lag(v) OVER (PARTITION BY id ORDER BY i) AS a, v AS b, row_number() OVER (PARTITION BY id ORDER BY i) AS k FROM seen),
  f AS (SELECT id, 1 AS k, 'NO_CONTENT' AS issue FROM c WHERE content = '' UNION ALL
    SELECT id, 2, 'VERY_SHORT' FROM c WHERE content <> '' AND length(content) < 30 AND NOT regexp_matches(content, 'See (Article|Section|Subsection|Note)') UNION ALL
    SELECT id, 3, 'NO_CLAUSE_START' FROM c WHERE length(content) > 50 AND NOT starts_with(t, '(1)') UNION ALL
    SELECT id, 4, 'CLAUSE_NOT_START_1' FROM steps WHERE k = 1 AND b <> 1 UNION ALL
    SELECT id, 5, concat('CLAUSE_GAP_', arg_min(a, i), '_to_', arg_min(b, i)) FROM steps WHERE b - a > 2 GROUP BY id UNION ALL
    SELECT id, 6, 'TRUNCATED_END' FROM c WHERE t <> '' AND right(t, 1) NOT IN ('.', ')', '"', ':') AND length(regexp_extract(t, '[^ \\t\\n\\r]+$')) > 2 AND NOT regexp_matches(t, '[0-9]$') UNION ALL
    SELECT id, 7, 'FORMULA_NO_WHERE' FROM c WHERE length(content) > 200 AND regexp_matches(content, '[A-Z][a-z]?\\s*=\\s*[A-Za-z0-9+*/()-]+') AND NOT contains(lower(content), 'where'))"""
add("A07_issue_histogram", lambda s, d: V.issue_kinds(_SCREEN(s, d)), _SCREENED + " SELECT split_part(issue, '_', 1) AS kind, count(*) AS n FROM f GROUP BY 1", "art")
add("V23_screened_articles", lambda s, d: _SCREEN(s, d).select("id", F.array_join("issues", ",").alias("issues")), _SCREENED + " SELECT id, string_agg(issue, ',' ORDER BY k) AS issues FROM f GROUP BY id", "art")
add("A08_pass_rate", lambda s, d: B(s, d, "labels").agg(F.round(F.avg(F.when(F.col("quality") == 1, 100.0).otherwise(0.0)), 4).alias("rate")), "SELECT round(avg(CASE WHEN quality = 1 THEN 100.0 ELSE 0.0 END), 4) AS rate FROM labels")
add("A09_corpus_stats", lambda s, d: art(s, d).agg(F.count("*").alias("articles"), F.sum(F.length("content")).alias("chars"), F.sum(F.regexp_count("content", F.lit("Table"))).alias("tables"), F.sum(F.regexp_count("content", F.lit(r"\n"))).alias("breaks")), "SELECT count(*) AS articles, CAST(sum(length(content)) AS BIGINT) AS chars, CAST(sum(len(regexp_extract_all(content, 'Table'))) AS BIGINT) AS tables, CAST(sum(length(content) - length(replace(content, chr(10), ''))) AS BIGINT) AS breaks FROM art", "art")
add("A10_distinct_references", lambda s, d: art(s, d).select("doc", F.array_join(F.array_distinct(F.regexp_extract_all("content", F.lit(r"Section (9\.\d+)"), 1)), ",").alias("refs")).filter("refs <> ''"),
    ", r AS (SELECT doc, unnest(regexp_extract_all(content, 'Section (9[.][0-9]+)', 1)) AS x, generate_subscripts(regexp_extract_all(content, 'Section (9[.][0-9]+)', 1), 1) AS i FROM art) SELECT doc, string_agg(x, ',' ORDER BY i) AS refs FROM (SELECT doc, x, min(i) AS i FROM r GROUP BY doc, x) GROUP BY doc", "art")
add("A11_duplicate_texts", lambda s, d: B(s, d, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1"), "SELECT sha256(text) AS sha, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
add("A12_tables_by_section", lambda s, d: M(s, d, "tables").groupBy(F.regexp_extract("id", r"Table (\d+\.\d+)", 1).alias("section")).agg(F.count("*").alias("n")), "SELECT regexp_extract(id, 'Table ([0-9]+[.][0-9]+)', 1) AS section, count(*) AS n FROM tables GROUP BY 1", "tables")


def methods(s: SparkSession, d: str) -> DataFrame:
    """Scores of extraction methods (ship modes of a kind: the line status and flag) on tables (orders)."""
    return B(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("table_id"), F.concat("l_returnflag", "l_linestatus").alias("method")).agg(F.sum(F.col("l_quantity").cast("long")).alias("score"))


METHODS = "SELECT l_orderkey AS table_id, concat(l_returnflag, l_linestatus) AS method, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS score FROM lineitem GROUP BY 1, 2"
add("A13_method_means", lambda s, d: methods(s, d).groupBy("method").agg(F.round(F.avg("score"), 4).alias("mean"), F.count("*").alias("n")), f"SELECT method, round(avg(score), 4) AS mean, count(*) AS n FROM ({METHODS}) GROUP BY method")
add("A14_winner", lambda s, d: methods(s, d).groupBy("method").agg(F.sum("score").alias("total")).orderBy(F.desc("total"), "method").limit(1), f"SELECT method, CAST(sum(score) AS BIGINT) AS total FROM ({METHODS}) GROUP BY method ORDER BY total DESC, method LIMIT 1")
add("A15_best_of_methods", lambda s, d: R.best_by(methods(s, d), "table_id", "method", "score"), f"SELECT table_id, method, score FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY score DESC, method) AS rn FROM ({METHODS})) WHERE rn = 1")
add("A16_best_on_page", lambda s, d: R.best_by(M(s, d, "tables").select("page", "id", (F.length("title") + F.when(F.col("html").isNotNull(), 5).otherwise(0)).alias("score")), "page", "id", "score"), "SELECT page, id, score FROM (SELECT page, id, CAST(length(title) + CASE WHEN html IS NOT NULL THEN 5 ELSE 0 END AS INT) AS score, row_number() OVER (PARTITION BY page ORDER BY length(title) + CASE WHEN html IS NOT NULL THEN 5 ELSE 0 END DESC, id) AS rn FROM tables) WHERE rn = 1", "tables")
add("A17_best_page", lambda s, d: M(s, d, "lines").filter(F.col("text").contains("Table")).groupBy("page").agg(F.count("*").alias("score")).orderBy(F.desc("score"), "page").limit(1), "SELECT page, count(*) AS score FROM lines WHERE contains(text, 'Table') GROUP BY page ORDER BY score DESC, page LIMIT 1", "lines")
add("A18_blank_percent", lambda s, d: G.blank_percent(M(s, d, "cells")), "SELECT table_id, round(avg(CASE WHEN trim(coalesce(cell, '')) = '' THEN 100.0 ELSE 0.0 END), 1) AS blank_percent FROM cells GROUP BY table_id", "cells")
add("A19_fill_and_keywords", lambda s, d: M(s, d, "cells").groupBy("table_id").agg(F.count_if(F.trim(F.coalesce("cell", F.lit(""))) != "").alias("filled"), F.count("*").alias("n"), F.bool_or(F.coalesce(F.col("cell").contains("Item"), F.lit(False))).alias("keyword")), "SELECT table_id, CAST(sum(CASE WHEN trim(coalesce(cell, '')) <> '' THEN 1 ELSE 0 END) AS BIGINT) AS filled, count(*) AS n, bool_or(coalesce(contains(cell, 'Item'), false)) AS keyword FROM cells GROUP BY table_id", "cells")
add("A20_highest_clause", lambda s, d: art(s, d).select("doc", F.coalesce(F.array_max(F.transform(F.regexp_extract_all("content", F.lit(r"(?m)^\((\d+)\)"), 1), lambda x: x.cast("int"))), F.lit(0)).alias("n")), "SELECT doc, CAST(max(CASE WHEN regexp_matches(text, '^[(][0-9]+[)]') THEN CAST(regexp_extract(text, '^[(]([0-9]+)[)]', 1) AS INT) ELSE 0 END) AS INT) AS n FROM lines GROUP BY doc", "lines")
add("A21_status_summary", lambda s, d: V.rendered(B(s, d, "pages")).groupBy("status").agg(F.count("*").alias("n")), "SELECT CASE WHEN NOT regexp_matches(html, '(?i)<title>') OR length(html) < 500 THEN 'FAIL' WHEN NOT regexp_matches(html, '(?i)<h[12][ >]') THEN 'WARN' ELSE 'PASS' END AS status, count(*) AS n FROM pages GROUP BY 1")
add("A22_changed_lines", lambda s, d: M(s, d, "lines").withColumn("new", X.emphasis_removed(X.links_unwrapped(F.col("text")))).filter("new <> text").groupBy("doc").agg(F.count("*").alias("changed"), F.array_join(F.slice(F.array_sort(F.collect_set("new")), 1, 10), "|").alias("examples")), "SELECT doc, count(*) AS changed, array_to_string(list_sort(list(DISTINCT x))[1:10], '|') AS examples FROM (SELECT doc, text, regexp_replace(regexp_replace(regexp_replace(text, '\\[([^\\]]+)\\]\\(#page-[0-9]+[^)]*\\)', '\\1', 'g'), '\\*\\*([^*\\n]+)\\*\\*', '\\1', 'g'), '\\*([^*\\n]+)\\*', '\\1', 'g') AS x FROM lines) WHERE x <> text GROUP BY doc", "lines")
