"""Registered queries on markdown books: import, blocks of tables, regions, the annotated view, stored search, chunks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import markup as U
from folioflow.functions import text as X
from folioflow.operators import annotate as A
from folioflow.operators import grids as G
from folioflow.operators import markdown as D
from folioflow.operators import quality as V
from folioflow.operators import relational as R
from folioflow.operators import search as K
from folioflow.operators import similarity as S
from folioflow.operators import tree as H
from folioflow.plans.catalog import DOCS, LINE_TYPE_SQL, B, M, add, art, docs, mart
from folioflow.plans.catalog_grids import _of
from folioflow.sources import files
from folioflow.sources.chunks import convert_pages
from folioflow.sources.relations import ARTICLES_SQL
from folioflow.sources.shared import fresh_folder


def _book(s: SparkSession, d: str) -> DataFrame:
    return D.rendered_lines(M(s, d, "nodes"))


def _marked_lines(s: SparkSession, d: str) -> DataFrame:
    return D.text_lines(mart(s, d), "doc", "content")


_L = ", l AS (SELECT doc, unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS i FROM mart)"

# ---- import
#: All parts as one book; blocks are runs of a section's subsections, whatever the section's length.
_ONE_BOOK = lambda s, d: _book(s, d).withColumn("doc", F.lit("all")).withColumn("block", F.concat(F.slice("block", 1, 2), F.expr("transform(slice(block, 3, 1), x -> x div 8192)")))
add("T15_part_slice", lambda s, d: D.part_slice(_ONE_BOOK(s, d), 3).select(F.array_join("at.k", ".").alias("id"), "at.sub", "text"),
    """, n AS (SELECT *, replace(replace(id, '(', ''), ')', '') AS k FROM nodes WHERE part = 3)
    SELECT k AS id, 0 AS sub, CASE type WHEN 'part' THEN '# Part ' || id WHEN 'section' THEN concat('# Section ', id, '. ', title) WHEN 'subsection' THEN concat('## ', id, '. ', title) ELSE concat('#### ', id, '. ', title) END AS text FROM n WHERE type <> 'clause'
    UNION ALL SELECT k, 1, CASE WHEN type = 'clause' THEN concat('(', seq, ') ', content) ELSE content END FROM n WHERE content <> ''""", "nodes")
add("T16_imported", lambda s, d: D.imported(_book(s, d)).select("id", "type", "parent_id", "title", "seq", F.sha2("content", 256).alias("sha")),
    """, c AS (SELECT parent_id, string_agg(concat('(', seq, ') ', content), chr(10) ORDER BY seq) AS content FROM nodes WHERE type = 'clause' GROUP BY parent_id)
    SELECT n.id, type, n.parent_id, title, CAST(row_number() OVER (PARTITION BY n.parent_id ORDER BY seq) AS INT) AS seq, CASE WHEN type <> 'section' THEN sha256(nullif(concat_ws(chr(10), nullif(n.content, ''), c.content), '')) END AS sha
    FROM nodes n LEFT JOIN c ON c.parent_id = n.id WHERE type IN ('section', 'subsection', 'article')""", "nodes")
add("T16_round_trip", lambda s, d: H.flat_content(D.imported(_book(s, d))).select("id", F.sha2("content", 256).alias("sha")),
    """, c AS (SELECT parent_id, string_agg(concat('(', seq, ') ', content), chr(10) ORDER BY seq) AS content FROM nodes WHERE type = 'clause' GROUP BY parent_id),
    a AS (SELECT n.*, concat_ws(chr(10), nullif(n.content, ''), c.content) AS body FROM nodes n LEFT JOIN c ON c.parent_id = n.id WHERE type = 'article')
    SELECT parent_id AS id, sha256(rtrim(string_agg(concat('#### ', id, '. ', title, chr(10), CASE WHEN body <> '' THEN chr(10) || body ELSE '' END), chr(10) || chr(10) ORDER BY seq), chr(10))) AS sha FROM a GROUP BY parent_id""", "nodes")

# ---- blocks of tables
_ID = r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+\.?-?[A-Z]?"
_BLOCKS = rf"""{_L},
  s AS (SELECT *, count(*) FILTER (starts_with(x, '## ') OR starts_with(x, '### ')) OVER (PARTITION BY doc ORDER BY i) AS seg, regexp_matches(x, '^(### +\*?\*?|\*\*)Table +{_ID}') AND NOT contains(x, '(Cont''d)') AS opens FROM l),
  t AS (SELECT *, min(i) FILTER (opens) OVER (PARTITION BY doc, seg) AS i0 FROM s),
  u AS (SELECT *, first_value(x) OVER (PARTITION BY doc, seg ORDER BY i) AS x0, i = i0 AS is_first, trim(x) AS y FROM t WHERE i >= i0),
  v AS (SELECT *, contains(x0, 'Forming Part') AS single, starts_with(y, '**') AND NOT contains(y, 'Notes') AS bold, contains(y, 'Forming Part') AS forming FROM u),
  w AS (SELECT *, min(i) FILTER (NOT is_first AND (single OR NOT (y = '' OR bold OR forming))) OVER (PARTITION BY doc, seg) AS i1 FROM v),
  z AS (SELECT *, NOT is_first AND (i1 IS NULL OR i < i1) AS head, i >= i1 AS tail FROM w),
  q AS (SELECT *, min(i) FILTER (tail AND contains(x, 'Notes to Table')) OVER (PARTITION BY doc, seg) AS i2 FROM z),
  b AS (SELECT doc, seg, any_value(regexp_extract(x0, 'Table +({_ID})', 1)) AS id,
    coalesce(CASE WHEN any_value(single) THEN any_value(trim(trim(regexp_extract(x0, 'Table\s+[0-9.\-A-Z]+\s+(.+?)\s*\*?\*?\s*Forming Part', 1), '*'))) ELSE trim(trim(arg_max(y, i) FILTER (head AND bold), '*')) END, '') AS title,
    coalesce(CASE WHEN any_value(single) THEN any_value(trim(regexp_extract(x0, 'Forming Part of Sentences?\s+([0-9.,() ]+)', 1))) ELSE trim(arg_max(regexp_extract(y, 'Forming Part of Sentences?\s+([0-9.,() ]+)', 1), i) FILTER (head AND forming AND NOT bold)) END, '') AS forming_part,
    coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (tail AND (i2 IS NULL OR i < i2) AND NOT starts_with(ltrim(x), '![]')), '') AS body,
    coalesce(list([regexp_extract(y, '^-?\s*\(([0-9]+)\)\s*(.+)$', 1), regexp_extract(y, '^-?\s*\(([0-9]+)\)\s*(.+)$', 2)] ORDER BY i) FILTER (i > i2 AND regexp_matches(y, '^-?\s*\([0-9]+\)\s*.')), []) AS notes,
    min(i) AS i0, max(i) AS i9 FROM q GROUP BY doc, seg)"""
add("T17_table_blocks", lambda s, d: D.table_blocks(mart(s, d)).select("doc", "id", "title", "forming_part", F.sha2("body", 256).alias("sha"), F.array_join(F.transform("notes", lambda x: F.concat(x["number"], F.lit("="), x["text"])), ";").alias("notes"), "flat"),
    f"{_BLOCKS} SELECT doc, id, title, forming_part, sha256(body) AS sha, array_to_string([n[1] || '=' || n[2] FOR n IN notes], ';') AS notes, NOT regexp_matches(body, '(?m)^\\|.+\\|') AND length(regexp_replace(body, '[\\n ]', '', 'g')) > 200 AS flat FROM b", "mart")
add("G14_exported_blocks", lambda s, d: D.exported(D.table_blocks(mart(s, d))).select("doc", "id", F.sha2("text", 256).alias("sha")),
    f"""{_BLOCKS}, rows AS (SELECT doc, seg, [trim(y) FOR y IN string_split(body, chr(10)) IF starts_with(trim(y), '|')] AS r FROM b),
    html AS (SELECT doc, seg, CASE WHEN len(r) >= 2 THEN '<table class="obc-table"><thead><tr>' || array_to_string(['<th>' || trim(c) || '</th>' FOR c IN string_split(r[1], '|')[2 : -2]], '') || '</tr></thead><tbody>'
      || array_to_string(['<tr>' || array_to_string(['<td>' || trim(c) || '</td>' FOR c IN string_split(y, '|')[2 : -2]], '') || '</tr>' FOR y IN r[CASE WHEN regexp_matches(r[2], '^\\|[\\s:-]+\\|') THEN 3 ELSE 2 END :]], '') || '</tbody></table>' ELSE '' END AS h FROM rows)
    SELECT doc, id, sha256(concat('#### Table ', id, ' ', title, CASE WHEN forming_part <> '' THEN ' Forming Part of Sentence ' || forming_part ELSE '' END, chr(10), chr(10), chr(10), chr(10),
      CASE WHEN NOT regexp_matches(body, '(?m)^\\|.+\\|') AND length(regexp_replace(body, '[\\n ]', '', 'g')) > 200 THEN concat('<p class="flat-table-warning">[Flat table - needs manual fix]</p>', chr(10), chr(10), body) WHEN h <> '' THEN h ELSE body END,
      CASE WHEN len(notes) > 0 THEN concat(chr(10), chr(10), chr(10), chr(10), 'Notes to Table ', id, ':', chr(10), chr(10), chr(10), chr(10), array_to_string(['- (' || n[1] || ') ' || n[2] FOR n IN notes], chr(10) || chr(10))) ELSE '' END)) AS sha FROM b JOIN html USING (doc, seg)""", "mart")
_NEW = "SELECT concat('9.', CAST(s_suppkey % 30 + 1 AS STRING), '.5.', CAST(s_suppkey % 7 + 1 AS STRING)) AS id, concat('<table>', s_name, '</table>') AS text FROM supplier"
add("G15_blocks_replaced", lambda s, d: D.blocks_replaced(mart(s, d), B(s, d, "supplier").select(F.concat(F.lit("9."), (F.col("s_suppkey") % 30 + 1).cast("string"), F.lit(".5."), (F.col("s_suppkey") % 7 + 1).cast("string")).alias("id"), F.concat(F.lit("<table>"), "s_name", F.lit("</table>")).alias("text"))).select("doc", F.sha2("content", 256).alias("sha")),
    f"""{_BLOCKS}, new AS (SELECT id, min(text) AS text FROM ({_NEW}) GROUP BY id), p AS (SELECT doc, i0, i9, text FROM b JOIN new USING (id))
    SELECT l.doc, sha256(string_agg(CASE WHEN p.text IS NULL THEN x WHEN i = i0 THEN p.text END, chr(10) ORDER BY i)) AS sha FROM l LEFT JOIN p ON p.doc = l.doc AND i BETWEEN i0 AND i9 GROUP BY l.doc""", "mart")

# ---- regions
add("W05_numbered_notes", lambda s, d: D.notes_numbered(_marked_lines(s, d)).filter("in_run").select("doc", "at", "text"),
    rf"""{_L}, h AS (SELECT *, contains(x, 'table-notes-title') OR starts_with(trim(x), 'Notes to Table') AS head, regexp_matches(trim(x), '^(#### Table|\[ARTICLE:|### )') AS ends FROM l),
  r AS (SELECT *, count(*) FILTER (head OR ends) OVER (PARTITION BY doc ORDER BY i) AS g FROM h), o AS (SELECT *, first_value(head) OVER (PARTITION BY doc, g ORDER BY i) AND NOT head AS inside FROM r),
  n AS (SELECT *, CAST(CASE WHEN inside THEN nullif(regexp_extract(trim(x), '^-?\s*\(([0-9]+)\)', 1), '') END AS BIGINT) AS n FROM o),
  k AS (SELECT *, lag(n) OVER (PARTITION BY doc, g ORDER BY i) AS b FROM n WHERE n IS NOT NULL), e AS (SELECT *, count(*) FILTER (n <= b AND b > 0) OVER (PARTITION BY doc, g ORDER BY i) AS stops FROM k)
  SELECT doc, CAST(i AS INT) AS at, CASE WHEN starts_with(ltrim(x), '-') THEN x ELSE regexp_replace(x, '^(\s*)', '\1- ') END AS text FROM e WHERE stops = 0""", "mart")
add("W08_repeated_tables", lambda s, d: D.repeated_tables_dropped(_marked_lines(s, d)).groupBy("doc").agg(F.count("*").alias("n"), F.sum("at").alias("places")),
    rf"""{_L}, t AS (SELECT *, nullif(regexp_extract(x, '^Table\s+(9\.[0-9]+\.[0-9]+\.[0-9]+(?:.-[A-G])?)', 1), '') AS id, regexp_matches(x, '^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+\.') AS art FROM l),
  k AS (SELECT *, id IS NOT NULL AND row_number() OVER (PARTITION BY doc, id ORDER BY i) > 1 AS again, count(*) FILTER (id IS NOT NULL OR art) OVER (PARTITION BY doc ORDER BY i) AS g FROM t),
  f AS (SELECT *, g > 0 AND first_value(again) OVER (PARTITION BY doc, g ORDER BY i) AS gone FROM k)
  SELECT doc, count(*) AS n, CAST(sum(i) AS BIGINT) AS places FROM f WHERE NOT gone GROUP BY doc""", "mart")
add("W09_flat_rows_dropped", lambda s, d: D.flat_rows_dropped(_marked_lines(s, d)).groupBy("doc").agg(F.count("*").alias("n"), F.sum("at").alias("places")),
    rf"""{_L}, t AS (SELECT *, trim(x) AS y FROM l), k AS (SELECT *, regexp_matches(y, '^Table\s+[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') AS opens, contains(y, 'Forming Part of') AS part, regexp_matches(y, '^Notes to Table|^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+\.?\s+\w|^\([0-9]+\)\s+\w') AS ends FROM t),
  st AS (SELECT *, last_value(CASE WHEN opens THEN true WHEN ends AND NOT part THEN false END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY i) AS flat FROM k)
  SELECT doc, count(*) AS n, CAST(sum(i) AS BIGINT) AS places FROM st WHERE NOT (coalesce(flat, false) AND NOT opens AND NOT part AND NOT ends AND regexp_matches(y, '^[0-9\s/—-]+$|^[A-Z][a-z]+\s+(of|for|in|to)\s+|^$')) GROUP BY doc""", "mart")


def _label_sql() -> str:
    whens = " ".join(f"WHEN regexp_matches(y, '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}'" for n, p in D.LABELS if n != "equation")
    equation = r"WHEN length(y) BETWEEN 3 AND 79 AND regexp_matches(y, '^[A-Za-z][a-z]?\s*=\s*[^,]+$') OR regexp_matches(y, '^\$\$.*\$\$$') THEN 'equation' "
    whens = whens.replace("WHEN regexp_matches(y, '^(?:[a-z]|", f"{equation}WHEN regexp_matches(y, '^(?:[a-z]|")
    return rf"""{_L}, t AS (SELECT *, trim(x) AS y FROM l WHERE trim(x) <> ''), o AS (SELECT *, CASE {whens} ELSE 'text' END AS own FROM t),
  r AS (SELECT *, last_value(CASE WHEN own = 'notes' THEN true WHEN regexp_matches(y, '{D.NOTES_ENDS}') THEN false END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY i) AS notes,
    last_value(CASE WHEN own = 'where' THEN true WHEN own = 'notes' OR regexp_matches(y, '{D.WHERE_ENDS}') THEN false END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY i) AS vars FROM o)
  SELECT doc, CAST(i AS INT) AS at, CASE WHEN own IN ('notes', 'where', 'table_html') THEN own WHEN notes AND regexp_matches(y, '^[-•]') THEN 'note_item' WHEN notes THEN 'note_text' WHEN coalesce(vars, false) AND regexp_matches(y, '{D.VARIABLE}') THEN 'variable' ELSE own END AS label FROM r"""


add("T24_labelled_lines", lambda s, d: D.labelled(_marked_lines(s, d)).select("doc", "at", "label"), _label_sql(), "mart")

# ---- annotations
_TERMS = ["the", "tion", "there", "her", "ou", "and the", "the the", "onhe", "than", "than the"]
_ASCII = f"SELECT id, regexp_replace(content, '[^ -~\\n]', '#', 'g') AS content FROM ({DOCS})"
_BY_LENGTH = "|".join(re.escape(t).replace("\\ ", " ") for t in sorted(_TERMS, key=lambda t: (-len(t), t)))
add("T19_defined_terms", lambda s, d: A.defined_terms(docs(s, d).select(F.col("id").alias("doc"), "content"), s.createDataFrame([(t,) for t in _TERMS], "term string")),
    rf"""WITH p AS (SELECT id, regexp_extract_all(content, '(?i)\b({_BY_LENGTH})\b') AS m, string_split_regex(content, '(?i)\b({_BY_LENGTH})\b') AS b FROM ({_ASCII})),
  x AS (SELECT id, unnest(m) AS match, generate_subscripts(m, 1) AS i, m, b FROM p), y AS (SELECT id, match, i, length(b[i]) AS before FROM x),
  z AS (SELECT id, match, sum(before + length(match)) OVER (PARTITION BY id ORDER BY i) AS e FROM y)
  SELECT id AS doc, CAST(e - length(match) AS INT) AS start, CAST(e AS INT) AS "end", lower(match) AS term FROM z""")
_DEFINED = ["beam", "wall", "snow load", "load", "first", "first case", "rule"]


def _view_sql(layers: list[tuple[str, str]]) -> str:
    steps, last = [], "SELECT doc, [content] AS s FROM mart WHERE content <> ''"
    for kind, pattern in layers:
        marked = f"string_split(regexp_replace(x, '({pattern})', chr(3) || chr(1) || '{kind}' || chr(2) || '\\1' || chr(3), 'g'), chr(3))"
        last = f"SELECT doc, flatten([CASE WHEN starts_with(x, chr(1)) THEN [x] ELSE [y FOR y IN {marked} IF y <> ''] END FOR x IN s]) AS s FROM ({last})"
    steps.append(f", v AS (SELECT doc, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM ({last}))")
    return f"""{''.join(steps)}, w AS (SELECT doc, i, CASE WHEN starts_with(x, chr(1)) THEN split_part(substring(x, 2), chr(2), 1) ELSE '' END AS kind, CASE WHEN starts_with(x, chr(1)) THEN split_part(x, chr(2), 2) ELSE x END AS t FROM v),
  e AS (SELECT *, sum(length(t)) OVER (PARTITION BY doc ORDER BY i) AS e FROM w) SELECT doc, CAST(e - length(t) AS INT) AS start, CAST(e AS INT) AS "end", kind, t AS match FROM e WHERE kind <> ''"""


_LAYERS = A.reading_layers(_DEFINED, "conform")
_SQL_LAYERS = [(k, rf"\b(?i:{'|'.join(sorted(_DEFINED, key=lambda t: (-len(t), t)))})\b" if k == "definition" else p) for k, p in _LAYERS]
add("T21_reading_view", lambda s, d: A.annotations(mart(s, d), _LAYERS), _view_sql(_SQL_LAYERS), "mart")
add("J17_equations_inserted", lambda s, d: mart(s, d).filter(F.contains("content", F.lit("as follows:"))).select("doc", F.sha2(U.equations_inserted(F.col("content"), [("as follows:", "$w = 3$"), ("$w = 3$", "$v$")]), 256).alias("sha")),
    "SELECT doc, sha256(concat(left(content, strpos(content, 'as follows:') + 10), chr(10), '$w = 3$', chr(10), '$v$', substring(content, strpos(content, 'as follows:') + 11))) AS sha FROM mart WHERE contains(content, 'as follows:')", "mart")

# ---- joins, grids, trees
_EVENTS = lambda s, d: B(s, d, "events").select(F.col("user_id").alias("page"), "event_id", "event_type", F.col("value").alias("y"), F.col("value").alias("x"))
_TITLE = "event_type IN ('signup', 'error')"
add("J11_nearest_below", lambda s, d: R.nearest_below(_EVENTS(s, d).filter(_TITLE), _EVENTS(s, d).filter(f"NOT {_TITLE}"), "page", "event_id", "event_id", "y", 2.0),
    f"""WITH RECURSIVE t AS MATERIALIZED (SELECT user_id AS page, list([value, event_id] ORDER BY value, CAST(event_id AS VARCHAR)) AS t FROM events WHERE {_TITLE} GROUP BY user_id), g AS MATERIALIZED (SELECT user_id AS page, list([value, event_id] ORDER BY value, CAST(event_id AS VARCHAR)) AS g FROM events WHERE NOT {_TITLE} GROUP BY user_id),
  r AS (SELECT page, 0 AS k, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS pick FROM t JOIN g USING (page) UNION ALL
    SELECT page, k, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, pick FROM (SELECT page, k, used, CASE WHEN g[p][1] - t[k][1] < 2.0 THEN p END AS pick, t, g
      FROM (SELECT r.page, r.k + 1 AS k, used, t, g, list_min([i FOR i IN range(1, len(g) + 1) IF g[i][1] >= t[r.k + 1][1] AND NOT list_contains(used, i)]) AS p FROM r JOIN t ON t.page = r.page JOIN g ON g.page = r.page WHERE r.k < len(t))))
  SELECT r.page, CAST(CAST(t[k][2] AS BIGINT) AS VARCHAR) AS title, CAST(CAST(g[pick][2] AS BIGINT) AS VARCHAR) AS grid FROM r JOIN t ON t.page = r.page JOIN g ON g.page = r.page WHERE pick IS NOT NULL""")
add("G17_column_clusters", lambda s, d: G.column_clusters(_EVENTS(s, d), 1.0).select("page", "event_id", "column", "centre"),
    """, e AS (SELECT user_id AS page, event_id, value AS x FROM events), n AS (SELECT *, CASE WHEN x - max(x) OVER (PARTITION BY page ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND 0.000000001 PRECEDING) > 1 THEN x END AS begins FROM e),
  c AS (SELECT page, event_id, x, (SELECT count(DISTINCT begins) FROM n b WHERE b.page = n.page AND b.begins <= n.x) + 1 AS c FROM n)
  SELECT page, event_id, CAST(c AS INT) AS "column", round(avg(x) OVER (PARTITION BY page, c), 6) AS centre FROM c""".replace(", e AS", "WITH e AS", 1))
add("G06_smart_html", lambda s, d: G.smart_html(M(s, d, "cells"), G.header_rows(M(s, d, "cells"))).select("table_id", F.sha2("html", 256).alias("sha")),
    f""", x AS (SELECT c.*, header_rows AS h, row <= header_rows AS head FROM cells c JOIN {_of('G05_header_rows')} h ON h.table_id = c.table_id),
  f AS (SELECT *, coalesce(col = 1 AND coalesce(trim(cell), '') <> '' AND trim(cell) = lag(trim(cell)) OVER (PARTITION BY table_id, col, head ORDER BY row), false) AS below, head AND col > 2 AND cell IS NULL AS covered FROM x),
  r AS (SELECT *, sum(CASE WHEN below THEN 0 ELSE 1 END) OVER (PARTITION BY table_id, col, head ORDER BY row) AS rr, sum(CASE WHEN covered THEN 0 ELSE 1 END) OVER (PARTITION BY table_id, row ORDER BY col) AS cc FROM f),
  n AS (SELECT *, count(*) OVER (PARTITION BY table_id, col, head, rr) AS rs, count(*) OVER (PARTITION BY table_id, row, cc) AS cs FROM r),
  t AS (SELECT table_id, row, h, head, string_agg(concat('<', CASE WHEN head OR col = 1 THEN 'th' ELSE 'td' END, CASE WHEN rs > 1 THEN concat(' rowspan="', rs, '"') ELSE '' END, CASE WHEN cs > 1 THEN concat(' colspan="', cs, '"') ELSE '' END, '>', coalesce(cell, ''), '</', CASE WHEN head OR col = 1 THEN 'th' ELSE 'td' END, '>'), chr(10) ORDER BY col) AS cells
    FROM n WHERE NOT below AND NOT covered GROUP BY table_id, row, h, head),
  o AS (SELECT *, concat(CASE WHEN head THEN '<tr>' WHEN (row - h) % 2 = 0 THEN '<tr class="bg-gray-50">' ELSE '<tr class="bg-white">' END, chr(10), cells, chr(10), '</tr>') AS line FROM t)
  SELECT table_id, sha256(concat('<table class="obc-table" data-table-id="Table ', table_id, '">', chr(10), '<thead>', chr(10), string_agg(line, chr(10) ORDER BY row) FILTER (head), chr(10), '</thead>', coalesce(chr(10) || '<tbody>' || chr(10) || (string_agg(line, chr(10) ORDER BY row) FILTER (NOT head)) || chr(10) || '</tbody>', ''), chr(10), '</table>')) AS sha FROM o GROUP BY table_id""", "cells")


def _script(s: SparkSession, d: str) -> DataFrame:
    """Nodes to be added: the typed lines of each document, in order; an id is what a line begins with."""
    typed = F.explode(F.filter(F.array(X.line_type(F.col("text"))), lambda x: x.isNotNull())).alias("type")  # a filter on the type would work it out again
    rows = M(s, d, "lines").select("doc", F.struct("page", "line", "text").alias("ord"), "text", typed)
    return rows.select("doc", "ord", "type", F.regexp_extract("text", r"^(\S+?)\.?\s", 1).alias("id"), F.lit(None).cast("string").alias("title"), F.col("text").alias("content"))


_RANK = "CASE type WHEN 'subsection' THEN 2 WHEN 'alt_subsection' THEN 2 WHEN 'article' THEN 3 WHEN 'article_suffix' THEN 3 WHEN 'article_0a' THEN 3 WHEN 'sub_article' THEN 3 WHEN 'clause' THEN 4 WHEN 'subclause' THEN 5 WHEN 'subsubclause' THEN 6 END"
add("H08_added_nodes", lambda s, d: H.added(_script(s, d)).select("doc", "id", "type", "parent_id", "seq", F.array_join("refs", ",").alias("refs")),
    rf""", ty AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY page, line, text) AS o, text, {LINE_TYPE_SQL} AS type, regexp_extract(text, '^(\S+?)\.?\s', 1) AS id FROM lines),
  k AS (SELECT *, {_RANK} AS r FROM ty WHERE type IS NOT NULL),
  u AS (SELECT a.doc, a.o, a.text, a.type, a.id, CASE WHEN a.type IN ('alt_subsection', 'article_suffix', 'article_0a', 'sub_article') THEN CASE WHEN contains(a.id, '.') THEN regexp_replace(a.id, '[.][^.]*$', '') END ELSE arg_max(b.id, b.o) END AS parent_id
    FROM k a LEFT JOIN k b ON b.doc = a.doc AND b.o < a.o AND b.r < a.r GROUP BY a.doc, a.o, a.text, a.type, a.id),
  q AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc, parent_id ORDER BY o) AS INT) AS seq, row_number() OVER (PARTITION BY doc, id ORDER BY o DESC) AS back, regexp_extract_all(text, '(?:Table|Articles?|Subsection|Section)\s+([0-9]+(?:\.[0-9]+)+[A-Z]?)', 1) AS m FROM u)
  SELECT doc, id, type, parent_id, seq, array_to_string([m[i] FOR i IN range(1, len(m) + 1) IF list_position(m, m[i]) = i], ',') AS refs FROM q WHERE back = 1""", "lines")

# ---- text against its source


def _with_source(s: SparkSession, d: str) -> DataFrame:
    """Documents beside a source that says the same in capitals, differs in some words, or is another text."""
    k = F.col("n_chars") % 3
    source = F.when(k == 0, F.upper("text")).when(k == 1, F.regexp_replace("text", r"\b(the|and|of|der|la)\b", "x")).otherwise(F.reverse("text"))
    return B(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), source.alias("source"))


add("V26_like_source", lambda s, d: S.dissimilar(_with_source(s, d)))

# ---- stored search
_PARTS = lambda s, d: B(s, d, "documents").select(F.col("lang").alias("part"), F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"))


def _indexed(s: SparkSession, d: str) -> str:
    path = fresh_folder(s, "search-index")
    K.write_search_index(_PARTS(s, d), path)
    return path


def _refreshed(s: SparkSession, d: str) -> DataFrame:
    """All parts are indexed, then one anew from its longer documents."""
    path = _indexed(s, d)
    K.write_search_index(_PARTS(s, d).filter("part = 'fr' AND length(content) > 1000"), path)
    return s.read.parquet(f"{path}/postings").groupBy("part").agg(F.sum("tf").alias("words"), F.countDistinct("id").alias("docs"))


_WORDS = f"WITH w AS (SELECT lang AS part, CAST(doc_id AS VARCHAR) AS id, [x for x in string_split_regex(lower(text), '[^a-z0-9]+') if x <> ''] AS w FROM documents)"
_FAMILIES = [("annt", ["annt", "annts", "annte", "anntes", "annted", "annting"]), ("than", ["than", "thans"])]
add("K03_stemmed_search", lambda s, d: K.indexed_search(s, _indexed(s, d), "Annting thans"),
    f"""{_WORDS}, sz AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM w),
    tf AS (SELECT id, term, count(*) AS tf, first(n) AS n FROM (SELECT id, len(w) AS n, unnest([CASE {" ".join(f"WHEN x IN ({', '.join(repr(y) for y in ys)}) THEN '{t}'" for t, ys in _FAMILIES)} END FOR x IN w]) AS term FROM w) WHERE term IS NOT NULL GROUP BY id, term),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
    SELECT id, score FROM (SELECT id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score, count(*) AS hit FROM tf JOIN df USING (term) CROSS JOIN sz GROUP BY id) WHERE hit = 2 ORDER BY score DESC, id LIMIT 20""")
add("K10_part_refreshed", _refreshed, f"{_WORDS} SELECT part, CAST(sum(len(w)) AS BIGINT) AS words, count(*) AS docs FROM w JOIN documents ON CAST(doc_id AS VARCHAR) = id WHERE len(w) > 0 AND (part <> 'fr' OR length(text) > 1000) GROUP BY part")
add("K09_search_response", lambda s, d: K.response(docs(s, d), " the src1 7 ").select("query", "total", F.array_join(F.transform("results", lambda x: F.concat_ws(":", x["id"], x["score"].cast("string"))), ",").alias("results")),
    f"SELECT 'the src1 7' AS query, count(*) AS total, string_agg(concat(id, ':', score), ',' ORDER BY score DESC, id) AS results FROM {_of('K01_ranked_search')}")


# ---- chunks
def _converted(s: SparkSession, d: str) -> DataFrame:
    """Pages as text, in chunks; a second run finds all of them done."""
    path = fresh_folder(s, "converted")
    pages = B(s, d, "pages").select(F.col("page_id").alias("page"), "html")
    convert = lambda rows: rows.select("chunk", "page", F.sha2(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", ""), 256).alias("sha"))
    convert_pages(pages, path, convert, 100, 3)
    return convert_pages(pages, path, convert, 100, 3)


add("S17_chunks", _converted, "SELECT page_id // 100 AS chunk, page_id AS page, sha256(regexp_replace(coalesce(html, ''), '<[^>]*>', '', 'g')) AS sha FROM pages")

# ---- sentences, slices, pages, reports
add("T11_sentences", lambda s, d: D.sentences(_marked_lines(s, d)).select("doc", "number", "letter", "text"),
    rf"""{_L}, t AS (SELECT doc, i, trim(x) AS x FROM l WHERE trim(x) <> ''), k AS (SELECT *, regexp_matches(x, '^\([0-9]+\)\s+.') AS s, regexp_matches(x, '^\([a-z]\)\s+.') AS c FROM t),
  g AS (SELECT *, count(*) FILTER (s) OVER w AS gs, count(*) FILTER (s OR c) OVER w AS g FROM k WINDOW w AS (PARTITION BY doc ORDER BY i)),
  f AS (SELECT doc, g, gs, arg_min(x, i) AS head, string_agg(CASE WHEN s OR c THEN regexp_replace(x, '^\([0-9a-z]+\)\s+', '') ELSE x END, ' ' ORDER BY i) AS text FROM g WHERE gs > 0 GROUP BY doc, g, gs),
  n AS (SELECT *, regexp_extract(head, '^\(([0-9]+)\)', 1) AS num, regexp_extract(head, '^\(([a-z])\)', 1) AS let FROM f)
  SELECT doc, CAST(first_value(num) OVER (PARTITION BY doc, gs ORDER BY g) AS BIGINT) AS number, nullif(let, '') AS letter, text FROM n""", "mart")
_SUBS = lambda s, d: M(s, d, "nodes").filter("type = 'subsection'")


def _slices(s: SparkSession, d: str) -> DataFrame:
    """Each subsection cut out of its section's lines by the ids that they begin with."""
    line = F.concat("id", F.lit(". "), "title", F.when(F.col("content") != "", F.concat(F.lit("\n"), "content")).otherwise(""))
    lines = _SUBS(s, d).select(F.col("parent_id").alias("doc"), "seq", F.posexplode(F.split(line, "\n", -1)).alias("sub", "text"))
    lines = lines.select("doc", F.expr("seq div 1024").alias("block"), F.struct("seq", "sub").alias("at"), "text")
    return D.slices(lines, _SUBS(s, d).select(F.col("parent_id").alias("doc"), "id")).select("id", "part")


add("T14_slices", _slices, "SELECT id, concat(id, '. ', title, CASE WHEN content <> '' THEN chr(10) || content ELSE '' END) AS part FROM nodes WHERE type = 'subsection'", "nodes")
_PAGE = lambda: F.concat(F.lit("9."), (F.col("doc") % 30).cast("string"), F.lit(".1.2.\nDivision B - Part 9 of it\n12\n"), F.when(F.col("doc") % 2 == 0, F.lit("of Division B – Part 9\n9.1.1.1.\n")).otherwise(""), "content", F.lit("\n20 Division B ? Part 9\n\n\nPart 9\nend"))
add("N01_pages_cleaned", lambda s, d: art(s, d).select("doc", F.sha2(X.page_cleaned(_PAGE()), 256).alias("sha")),
    r""", p AS (SELECT doc, concat('9.', doc % 30, '.1.2.', chr(10), chr(10), CASE WHEN doc % 2 = 0 THEN 'of Division B – Part 9' || chr(10) || '9.1.1.1.' || chr(10) ELSE '' END, content, chr(10), chr(10), chr(10), chr(10), 'end') AS t FROM art),
    q AS (SELECT doc, array_to_string([CASE WHEN regexp_matches(x, '^([0-9]+\s*|[0-9]{4}\s+Building Code.*)$') THEN '' ELSE x END FOR x IN string_split(t, chr(10))], chr(10)) AS t FROM p),
    r AS (SELECT doc, CASE WHEN doc % 2 = 0 THEN replace(replace(t, 'of Division B – Part', 'of '), concat('9.', doc % 30, '.1.2.', chr(10)), chr(10)) ELSE t END AS t FROM q)
    SELECT doc, sha256(trim(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), chr(10) || ' ')) AS sha FROM r""", "art")
add("N30_section_tails", lambda s, d: mart(s, d).select("doc", F.concat("content", F.lit(" Section 9."), (F.col("doc") % 40).cast("string"), F.lit(". Stairs of (1) x")).alias("c"), "content").select("doc", X.section_tail_trimmed(F.col("c")).alias("x"), "content").select("doc", (F.length("content") - F.length("x")).alias("cut"), F.sha2("x", 256).alias("sha")),
    r", x AS (SELECT doc, content, rtrim(regexp_replace(content, '\s*Section\s+9\.[0-9]+\.?\s+[A-Z][^\n]*$', ''), chr(10) || ' ' || chr(9)) AS x FROM mart) SELECT doc, CAST(length(content) - length(x) AS INT) AS cut, sha256(x) AS sha FROM x", "mart")
add("S27_report", lambda s, d: V.report(V.screened(_titled(s, d)).join(_titled(s, d), "id")).select("issues", "id", F.sha2("text", 256).alias("sha")),
    f"""SELECT CAST(len(string_split(i.issues, ',')) AS INT) AS issues, i.id, sha256(concat(i.id, chr(10), '  Title: ', coalesce(o_orderpriority, ''), chr(10), '  Page: ', a.page, chr(10), '  Content Length: ', length(a.content), chr(10), '  Issues: ', replace(i.issues, ',', ', '), chr(10), chr(10))) AS sha
    FROM {_of('V23_screened_articles')} i JOIN ({ARTICLES_SQL}) a ON a.doc = i.id JOIN orders ON o_orderkey = i.id""")


def _titled(s: SparkSession, d: str) -> DataFrame:
    titles = B(s, d, "orders").select(F.col("o_orderkey").alias("_k"), F.col("o_orderpriority").alias("title"))
    return art(s, d).join(titles, F.col("doc") == F.col("_k")).select(F.col("doc").alias("id"), "title", "page", "content")


def _expected(s: SparkSession, d: str) -> DataFrame:
    k = F.col("seq")
    number = lambda n: (k % n + 1).cast("string")
    table = F.concat(F.lit("Table "), number(9), F.lit("."), number(13), F.lit("."), number(17), F.lit("."), k.cast("string"), F.when(k % 5 == 0, ".-A").when(k % 5 == 1, "B").otherwise(""))
    return _SUBS(s, d).select("id", F.when(k % 10 == 0, "Builder").otherwise("CUSTOMER").alias("title"), (k % 15).alias("min_articles"), F.array(table).alias("tables"))


def _sections(s: SparkSession, d: str) -> DataFrame:
    n = M(s, d, "nodes").filter("type = 'article'").groupBy(F.col("parent_id").alias("_p")).agg(F.count("*").alias("n"))
    return _SUBS(s, d).join(n, F.col("id") == F.col("_p"), "left").select("id", "title", "content", F.coalesce("n", F.lit(0)).alias("articles"))


add("V30_unexpected", lambda s, d: V.unexpected(_sections(s, d), _expected(s, d), M(s, d, "tables"), 12),
    """, n AS (SELECT parent_id, count(*) AS n FROM nodes WHERE type = 'article' GROUP BY parent_id), u AS (SELECT id, seq AS k, content, coalesce(n, 0) AS n FROM nodes LEFT JOIN n ON n.parent_id = id WHERE type = 'subsection'),
    t AS (SELECT u.id, CAST(regexp_extract(t.id, '^Table [0-9]+[.][0-9]+[.][0-9]+[.]([0-9]+)', 1) AS BIGINT) AS p, t.id AS tid, html, k FROM u LEFT JOIN tables t ON CAST(regexp_extract(t.id, '^Table [0-9]+[.][0-9]+[.][0-9]+[.]([0-9]+)', 1) AS BIGINT) = k)
    SELECT id, 'TITLE' AS issue FROM u WHERE k % 10 = 0 UNION ALL SELECT id, 'CONTENT' FROM u WHERE length(coalesce(content, '')) < 12 UNION ALL SELECT id, 'ARTICLES' FROM u WHERE n < k % 15
    UNION ALL SELECT id, 'LITTLE_HTML ' || tid FROM t WHERE length(coalesce(html, '')) < 50 AND tid IS NOT NULL
    UNION ALL SELECT id, concat('NO_TABLE Table ', k % 9 + 1, '.', k % 13 + 1, '.', k % 17 + 1, '.', k, CASE k % 5 WHEN 0 THEN '.-A' WHEN 1 THEN 'B' ELSE '' END) FROM t WHERE tid IS NULL""", "nodes", "tables")


# ---- sinks
def _json_written(s: SparkSession, d: str) -> DataFrame:
    path, rows = fresh_folder(s, "tables-json"), M(s, d, "tables")
    files.write_json(rows, path)
    return s.read.schema(rows.schema).json(path)


def _parts_written(s: SparkSession, d: str) -> DataFrame:
    """Nodes are stored by part, then one part anew without its articles and clauses."""
    path, nodes = fresh_folder(s, "nodes"), M(s, d, "nodes")
    files.write_parts(nodes, path)
    files.write_parts(nodes.filter("part = 2 AND type IN ('part', 'section', 'subsection')"), path)
    return s.read.parquet(path).groupBy("part", "type").agg(F.count("*").alias("n"), F.max("seq").alias("last"))


add("S18_json_written", _json_written, "SELECT * FROM tables", "tables")
add("S19_parts_written", _parts_written, "SELECT part, type, count(*) AS n, max(seq) AS last FROM nodes WHERE part <> 2 OR type IN ('part', 'section', 'subsection') GROUP BY part, type", "nodes")
add("F02_stored_part", lambda s, d: _stored_part(s, d).select("id", "type", "title"), "SELECT id, type, title FROM nodes WHERE part = 3 AND type <> 'clause'", "nodes")


def _stored_part(s: SparkSession, d: str) -> DataFrame:
    """One part's rows of stored nodes: only that part's files are read."""
    path = fresh_folder(s, "nodes")
    files.write_parts(M(s, d, "nodes"), path)
    return s.read.parquet(path).filter("part = 3 AND type <> 'clause'")
