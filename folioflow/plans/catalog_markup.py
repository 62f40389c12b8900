"""Registered queries on marked-up text: normalisers, references, pipe tables, checks of content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import markup as U
from folioflow.functions import text as X
from folioflow.operators import quality as V
from folioflow.plans.catalog import DOCS, M, add, docs, mart


def _changed(name: str, f: Callable[[Column], Column], sql: str) -> None:
    """The texts that a normaliser changes, with what comes out; sql is its twin on content."""
    add(name, lambda s, d: mart(s, d).select("doc", F.explode(F.filter(F.array(f(F.col("content"))), lambda new: new != F.col("content"))).alias("new")), f"SELECT doc, new FROM (SELECT doc, content, {sql} AS new FROM mart) WHERE new <> content", "mart")


def _chain(expression: str, *rules: tuple[str, str]) -> str:
    for pattern, to in rules:
        expression = f"regexp_replace({expression}, '{pattern}', '{to}', 'g')"
    return expression


def _regions(change: str) -> str:
    """SQL of content with `change` (of x) applied to the regions of notes."""
    cut = r"""string_split(regexp_replace(content, '(<h5 class="table-notes-title">Notes to Table[^<]+</h5>\s*\n|\[ARTICLE:|#### Table)', chr(1) || '\1', 'g'), chr(1))"""
    return f"""array_to_string([CASE WHEN starts_with(x, '<h5 class="table-notes-title">Notes to Table') AND contains(x, '</h5>') THEN {change} ELSE x END FOR x IN {cut}], '')"""


_ID = r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+\.?-?[A-Z]?"
_lines = lambda s, d: M(s, d, "marked").filter("line = 0")

# ---- headings
add("N08_article_markers", lambda s, d: _lines(s, d).select("doc", X.marked_articles(F.col("text")).alias("new")),
    r"""SELECT doc, CASE WHEN regexp_matches(text, '^#{1,4} [0-9]+\.[0-9]+\.3A?\.5B?\. ') THEN concat(chr(10), '[ARTICLE:', rtrim(split_part(text, ' ', 2), '.'), ':', CASE doc % 5 WHEN 0 THEN 'Loads' WHEN 1 THEN 'Spans' WHEN 2 THEN 'Rules of' ELSE regexp_extract(text, '\. ([^.]*)$', 1) END, ']') ELSE text END AS new FROM marked WHERE line = 0""", "marked")
add("N15_heading_levels", lambda s, d: _lines(s, d).select("doc", X.headings_leveled(F.col("text")).alias("new")),
    r"""SELECT doc, CASE WHEN NOT regexp_matches(text, '^#+ (Section )?(9|10|11|12)\.') THEN text WHEN regexp_matches(text, '^#+ [0-9]+\.[0-9]+\.3A?\.5') THEN regexp_replace(text, '^#+', '####')
    WHEN regexp_matches(text, '^#+ [0-9]+\.[0-9]+\.3A?\. ') THEN regexp_replace(text, '^#+', '###') WHEN regexp_matches(text, '^#+ (Section )?[0-9]+\.[0-9]+\. ') THEN regexp_replace(text, '^#+', '##') ELSE text END AS new FROM marked WHERE line = 0""", "marked")
add("T13_title_parts", lambda s, d: _lines(s, d).select("doc", U.title_parts(F.regexp_replace("text", r"^#+ ", "")).alias("t")).select("doc", "t.id", "t.name"),
    r""", t AS (SELECT doc, regexp_replace(text, '^#+ ', '') AS t FROM marked WHERE line = 0), p AS (SELECT doc, t, CASE WHEN starts_with(t, 'Section 9.') THEN len('Section 9.') + strpos(substring(t, 11), '.') WHEN regexp_matches(t, '^9\.[0-9]+\.[0-9]+(\.[0-9]+[A-Z]?)?\. ') THEN strpos(t, '. ') END AS pos FROM t)
    SELECT doc, coalesce(replace(left(t, CAST(pos - 1 AS INT)), 'Section ', ''), '') AS id, CASE WHEN pos IS NULL THEN t ELSE ltrim(substring(t, CAST(pos + 1 AS INT)), ' ') END AS name FROM p""", "marked")

# ---- normalisers
_changed("N09_clauses_cleaned", U.clauses_cleaned, "replace(" + _chain(_regions(r"regexp_replace(x, '(?m)^- \(([0-9]+)\)', chr(2) || '(\1)', 'g')"), (r"(?m)^\s*-\s*\*{0,2}\(([0-9]+\.[0-9]+)\)\*{0,2}", r"(\1)"), (r"(?m)^\s*-\s*\*{0,2}\(([0-9]+)\)\*{0,2}", r"(\1)"), (r"(?m)^\s*-\s*\(([a-z])\)", r"(\1)"), (r"(?m)^\s*-\s*\(([ivx]+)\)", r"(\1)"), (r"\*\*\(([0-9]+)\)\*\*", r"(\1)"), (r"(?m)^- (\. )?\(See Note", "(See Note")) + ", chr(2), '- ')")
_changed("N10_table_headings", U.table_headings, _chain("content", (rf"(#### Table {_ID}[^\n]*)\n+\*([Ff]orming [Pp]art[^*]+)\*", r"\1 \2"), (rf"<h4[^>]*>Table ({_ID})\s+([^<]+)</h4>", r"#### Table \1 \2"), (rf"<h4[^>]*>Table ({_ID})</h4>\s*<p[^>]*><em>(Forming Part[^<\n]*)</em></p>", r"#### Table \1  \2"), (rf"### Table ({_ID})\n+\*\*([^*]+)\*\*\n+\*([Ff]orming [Pp]art[^*]+)\*", r"#### Table \1 \2 \3"), (rf"### Table ({_ID})\n+\*\*([^*]+)\*\*", r"#### Table \1 \2"),
    (rf"(?:### )?\*\*Table ({_ID})\s+([^*]+)\*\*\s*([Ff]orming [Pp]art[^\n]*)", r"#### Table \1 \2 \3"), (rf"\*\*Table ({_ID})\s+([^*\n]+)\*\*", r"#### Table \1 \2"), (rf"(#### Table {_ID}[^\n]*)\n+([Ff]orming [Pp]art of [Ss]entences?\s+[0-9.,()and\s]+)", r"\1 \2")))
_changed("N12_notes_headings", U.notes_headings, _chain("content", (r"(?:\*\*|<h5 class=\"table-notes-title\">)*(Notes to Table " + _ID + r":)(?:\*\*|</h5>)*", r'<h5 class="table-notes-title">\1</h5>')))
add("N12_twice_is_once", lambda s, d: mart(s, d).filter(U.notes_headings(U.notes_headings(F.col("content"))) == U.notes_headings(F.col("content"))).agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM mart", "mart")
_changed("N13_notes_dashed", U.notes_dashed, _regions(r"regexp_replace(x, '(?m)^(\s*)\(([0-9]+)\)', '\1- (\2)', 'g')"))
_STOP = r"\n\n\n|\([0-9]+\)|\([a-z]\)|\[ARTICLE:|#### Table"
_changed("N14_where_blocks", U.where_blocks, rf"""(SELECT array_to_string([CASE WHEN i = 1 THEN p[i] ELSE concat(regexp_replace(CASE WHEN regexp_matches(p[i], '{_STOP}') THEN regexp_extract(p[i], '(?s)^(.*?)(?:{_STOP})', 1) ELSE p[i] END, '(?m)^[ \t]*([A-Za-zγ]{{1,3}})[ \t]+(?:is|=)[ \t]+(.*[^\s])[ \t]*$', '- \1 = \2', 'g'),
    CASE WHEN regexp_matches(p[i], '{_STOP}') THEN substring(p[i], length(regexp_extract(p[i], '(?s)^(.*?)(?:{_STOP})', 1)) + 1) ELSE '' END) END FOR i IN range(1, len(p) + 1)], 'where,' || chr(10)) FROM (SELECT string_split(regexp_replace(content, '(?m)^where[ \t]*:[ \t]*$', 'where,', 'g'), 'where,' || chr(10)) AS p))""")
_changed("N17_orphan_references", U.orphan_references_dropped, r"array_to_string([x FOR x IN string_split(content, chr(10)) IF NOT regexp_matches(trim(x), '^9\.[0-9]+\.[0-9]+\.[0-9]*\.?$') AND NOT regexp_matches(trim(x), '^9(\.[0-9]+){3}\.\s*to\s+9(\.[0-9]+){3}\.\)?$')], chr(10))")
_changed("N18_sentences_joined", X.sentences_joined, "replace(" + _chain("content", (r"\n(Table|Notes|Section|Article|Forming|9\.)", "\x01\\1"), (r"([a-z])\n([A-Z][a-z]{2,})", r"\1 \2")) + ", chr(1), chr(10))")
_changed("N19_fragments_merged", U.fragments_merged, _chain("content", *[(r"[ \t]*\n[ \t]*([a-z]{1,13}\.)[ \t]*(\n|$)", r" \1\2")] * 3, *[(r"[ \t]*\n[ \t]*\.[ \t]*(\n|$)", r".\1")] * 3, (r"(\(See also[^)\n]*[^)\s])[ \t]*\n[ \t]*([0-9.]+\))", r"\1 \2")))
_changed("N20_titles_merged", U.titles_merged, r"""(SELECT string_agg(y, chr(10) ORDER BY g) FROM (SELECT g, CASE WHEN count(*) > 1 AND regexp_matches(trim(arg_min(x, i)), '^[0-9]+\.[0-9]+\.[0-9]+\.?\s*\w') THEN string_agg(CASE WHEN opens THEN rtrim(x) ELSE trim(x) END, ' ' ORDER BY i) ELSE string_agg(x, chr(10) ORDER BY i) END AS y
    FROM (SELECT *, count(*) FILTER (opens) OVER (ORDER BY i) AS g FROM (SELECT *, i = 1 OR NOT regexp_matches(lower(x), '^[ \t]*(and|or|in|of|for|to|the|with)[ \t]+\w') AS opens FROM (SELECT unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) AS i))) GROUP BY g))""")
_changed("N21_broken_lines_joined", U.broken_lines_joined, r"""(SELECT string_agg(CASE WHEN i = 1 THEN '' WHEN regexp_matches(x, '^(?:where\b|[a-zγ]{1,3}\s*=|\[SECTION:|\[ARTICLE:|\[SUBSECTION:|[(0-9A-Z]|</?[a-z]|#{2,4}\s|\*{1,2}[A-Z(]|\s*-\s)') OR x = '' AND i < n THEN chr(10) ELSE ' ' END || x, '' ORDER BY i)
    FROM (SELECT unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) AS i, len(string_split(content, chr(10))) AS n))""")
_changed("N24_units_prettified", U.units_prettified, "replace(CASE WHEN regexp_matches(content, '\\$[^$]+\\$') THEN content ELSE " + _chain("content", (r"([0-9]+(?:\.[0-9]+)?)\s*°\s*([CF])\b", r"\1°\2"), (r"([0-9]+(?:\.[0-9]+)?)\s*(m²|m³|ft²|mm²)", r"\1 \2"), (r"\s*>=\s*", " ≥ "), (r"\s*<=\s*", " ≤ "), (r"\+/-", "±")) + " END, '<sup>3</sup>', '³')")

# ---- lines and references
add("T04_id_lines", lambda s, d: M(s, d, "marked").select("doc", "line", U.id_line(F.col("text")).alias("x")).filter("x IS NOT NULL").select("doc", "line", "x.type", "x.id"),
    r"SELECT doc, line, CASE len(string_split(text, '.')) WHEN 4 THEN 'subsection' ELSE 'article' END AS type, rtrim(text, '.') AS id FROM marked WHERE regexp_full_match(text, '9(\.[0-9]+){2,3}\.')", "marked")
_ANY = r"Table\s+9\.[0-9]+\.[0-9]+\.[0-9]+(?:\.-[A-Z])?\.?|Articles?\s+[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+\.?|Sentences?\s+[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+\.\([0-9]+\)|Subsection\s+[0-9]+\.[0-9]+\.[0-9]+\.?|Section\s+[0-9]+\.[0-9]+\.[0-9]+\.?|Clause\s+[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+\.\([0-9]+\)\([a-z]\)|Part\s+9\b"
_REFS = rf""", p AS (SELECT doc, content, regexp_extract_all(content, '{_ANY}') AS m, string_split_regex(content, '{_ANY}') AS b FROM mart),
  x AS (SELECT doc, content, unnest(m) AS match, generate_subscripts(m, 1) AS i, m, b FROM p),
  r AS (SELECT doc, match, CAST(list_sum([length(y) FOR y IN b[1 : i]]) + coalesce(list_sum([length(y) FOR y IN m[1 : i - 1]]), 0) AS INT) AS start FROM x),
  refs AS (SELECT doc, start, CAST(start + length(match) AS INT) AS "end", rtrim(lower(split_part(match, ' ', 1)), 's') AS type, split_part(match, ' ', 2) AS target, match FROM r)"""
_refs = lambda s, d: U.positional_references(mart(s, d).withColumnRenamed("doc", "id")).withColumnRenamed("id", "doc")
add("T06_positional_references", _refs, f'{_REFS} SELECT doc, start, "end", type, target, match FROM refs', "mart")
add("T21_linked_references", lambda s, d: _refs(s, d).select("doc", "start", X.reference_path(F.col("target"), F.col("type")).alias("path")).filter("path IS NOT NULL"),
    rf"{_REFS} SELECT doc, start, CASE WHEN type = 'part' THEN '/' ELSE concat('/code/', regexp_extract(target, '^(9\.[0-9]+\.[0-9]+)', 1)) END AS path FROM refs WHERE type = 'part' OR regexp_matches(target, '^9\.[0-9]+\.[0-9]+')", "mart")
add("T20_see_notes", lambda s, d: M(s, d, "marked").select("doc", F.explode(F.regexp_extract_all("text", F.lit(r"(?i)\(See\s+Notes?\s+([^()]+)\)"), 1)).alias("note")).groupBy("note").agg(F.count("*").alias("n")),
    r"SELECT note, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\(See Notes? ([^()]+)\)', 1)) AS note FROM marked) GROUP BY note", "marked")
add("T23_table_listing", lambda s, d: mart(s, d).select("doc", F.array_join(F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?i)Table\s+(\d+(?:\.\d+){3}(?:\.?-[A-Z])?)"), 1)), ",").alias("tables")).filter("tables <> ''"),
    r", t AS (SELECT doc, unnest(x) AS t, generate_subscripts(x, 1) AS i FROM (SELECT doc, regexp_extract_all(content, '(?i)Table\s+([0-9]+(?:\.[0-9]+){3}(?:\.?-[A-Z])?)', 1) AS x FROM mart)) SELECT doc, string_agg(t, ',' ORDER BY i) AS tables FROM (SELECT doc, t, min(i) AS i FROM t GROUP BY doc, t) GROUP BY doc", "mart")

# ---- pipe tables
_ROWS = r""", l AS (SELECT doc, unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM mart),
  m AS (SELECT *, starts_with(ltrim(x), '|') AS p, i - row_number() OVER (PARTITION BY doc, starts_with(ltrim(x), '|') ORDER BY i) AS run FROM l),
  k AS (SELECT *, count(*) OVER (PARTITION BY doc, p, run) AS n, row_number() OVER (PARTITION BY doc, p, run ORDER BY i) AS r FROM m),
  c AS (SELECT *, array_to_string(['<' || CASE r WHEN 1 THEN 'th' ELSE 'td' END || '>' || trim(y) || '</' || CASE r WHEN 1 THEN 'th' ELSE 'td' END || '>' FOR y IN string_split(trim(x), '|')[2 : -2]], '') AS t FROM k),
  h AS (SELECT doc, p, n, min(i) AS i, string_agg(x, chr(10) ORDER BY i) AS raw,
    '<table class="obc-table"><thead>' || max(CASE WHEN r = 1 THEN '<tr>' || t || '</tr>' END) || '</thead><tbody>' || coalesce(string_agg('<tr>' || t || '</tr>', '' ORDER BY i) FILTER (r > 1 AND NOT (r = 2 AND regexp_matches(trim(x), '^\|[\s:-]+\|'))), '') || '</tbody></table>' AS html
    FROM c GROUP BY doc, p, run, n)"""
add("G02_pipe_table_html", lambda s, d: M(s, d, "marked").filter(F.col("text").startswith("|")).select("doc", "line", U.pipe_table_html(F.col("text")).alias("html")),
    """SELECT doc, line, concat('<table class="obc-table"><thead><tr><th>Span, m</th><th>Size</th></tr></thead><tbody><tr><td>', split_part(split_part(text, chr(10), 3), ' ', 2), '</td><td>38 x 89</td></tr><tr><td>4</td><td></td></tr></tbody></table>') AS html FROM marked WHERE starts_with(text, '|')""", "marked")
_changed_in_place = lambda s, d: mart(s, d).select("doc", F.sha2(U.pipe_tables_converted(F.col("content")), 256).alias("sha"))
add("G04_tables_in_place", _changed_in_place, f"{_ROWS} SELECT doc, sha256(string_agg(CASE WHEN p AND n >= 2 THEN html ELSE raw END, chr(10) ORDER BY i)) AS sha FROM h GROUP BY doc", "mart")

# ---- checks of content
_PRE = r", c AS (SELECT doc AS id, content FROM mart)"
add("V24_content_checks", lambda s, d: V.content_checks(mart(s, d).select(F.col("doc").alias("id"), F.regexp_extract("content", r"9(?:\.\d+)+", 0).alias("section"), "content")),
    _PRE + r""", f AS (SELECT id, 'SHORT' AS issue FROM c WHERE length(content) < 200 UNION ALL
  SELECT id, 'SEPARATED' FROM c WHERE len([x FOR x IN regexp_extract_all(content, '\n([a-z][^\n]{10,60})', 1) IF NOT regexp_matches(x, '^(and|or|the|a) ')]) > 0 UNION ALL
  SELECT id, concat('INLINE_', l) FROM c, (VALUES ('a'), ('b'), ('c')) v(l) WHERE contains(content, '(' || l || ')') AND NOT regexp_matches(content, '(?m)(?:^|\n|:\s*)\(' || l || '\)') AND NOT regexp_matches(content, '(?i)(?:see|in|under|per)\s+\(' || l || '\)'))
  SELECT id, issue FROM f UNION ALL SELECT id, 'NO_EQUATION' FROM c WHERE regexp_matches(regexp_extract(content, '9(?:\.[0-9]+)+'), '^(9\.4\.2|9\.8|9\.25)') AND contains(lower(content), 'shall be calculated') AND NOT regexp_matches(content, '[A-Za-z]\s*=\s*[0-9A-Za-z_\s+*/()-]|[≤≥×÷√]')""", "mart")
add("V25_missing_equations", lambda s, d: V.equation_markers(mart(s, d).select(F.col("doc").alias("id"), "content")),
    _PRE + r""", p AS (SELECT id, content, regexp_extract_all(content, '(?i)(?:calculated as follows|shall be determined by)[:\s]*') AS m, string_split_regex(content, '(?i)(?:calculated as follows|shall be determined by)[:\s]*') AS b FROM c),
  x AS (SELECT id, content, unnest(m) AS y, generate_subscripts(m, 1) AS i, m, b FROM p), e AS (SELECT id, substring(content, CAST(list_sum([length(z) FOR z IN b[1 : i]]) + list_sum([length(z) FOR z IN m[1 : i]]) AS INT) + 1, 200) AS after FROM x)
  SELECT id, count(*) AS markers, CAST(sum(CASE WHEN regexp_matches(after, '[A-Za-z]\s*=\s*[^,\n]{5,}') THEN 0 ELSE 1 END) AS BIGINT) AS missing FROM e GROUP BY id""", "mart")
add("V29_left_over_lines", lambda s, d: V.left_over(mart(s, d).select(F.col("doc").alias("id"), "content")),
    _PRE + r""" SELECT id, CAST(len([x FOR x IN string_split(content, chr(10)) IF regexp_full_match(trim(x), '[0-9]{1,3}') AND NOT regexp_full_match(trim(x), '0+')]) AS BIGINT) AS page_numbers,
  len([i FOR i IN range(1, len(string_split_regex(content, '\s+'))) IF regexp_matches(string_split_regex(content, '\s+')[i], '9\.[0-9]+\.[0-9]+\.[0-9]+\.$') AND starts_with(string_split_regex(content, '\s+')[i + 1], regexp_extract(string_split_regex(content, '\s+')[i], '9\.[0-9]+\.[0-9]+\.[0-9]+\.$'))]) > 0 AS doubled,
  CAST(len([x FOR x IN string_split(content, chr(10)) IF regexp_full_match(trim(x), '9\.[0-9]+\.[0-9]+\.[0-9]*\.?')]) AS BIGINT) AS orphans FROM c""", "mart")
add("V32_left_over_markup", lambda s, d: V.left_over_markup(mart(s, d).select(F.col("doc").alias("id"), "content"), "9"),
    _PRE + r""" SELECT id, issue FROM (SELECT id, unnest(['HEADING', 'ARTICLE', 'BOLD_NUMBER', 'ITALIC', 'LETTER_MARK', 'NUMBER_MARK']) AS issue, unnest([regexp_matches(content, '(?m)^#{1,4}\s+'), regexp_matches(content, '\*\*9\.[0-9]+\.[0-9]+\.[0-9]+\.'), regexp_matches(content, '\*\*\([0-9]+\)\*\*'),
  regexp_matches(content, '(?:^|[^*])\*[a-zA-Z]{2,20}\*(?:[^*]|$)'), regexp_matches(content, '(?m)^- \([a-z]\)'), regexp_matches(content, '(?m)^- \([0-9]+\)')]) AS hit FROM c) WHERE hit""", "mart")
add("K04_marked_snippet", lambda s, d: docs(s, d).select("id", U.marked_snippet(F.col("content"), "th").alias("snippet")).filter("snippet IS NOT NULL"),
    f"""WITH w AS (SELECT id, [x FOR x IN string_split_regex(content, '[ \\t\\n\\f\\r\\x0B]+') IF x <> ''] AS w FROM ({DOCS})), h AS (SELECT id, w, list_position([starts_with(lower(x), 'th') FOR x IN w], true) AS pos FROM w)
  SELECT id, concat(CASE WHEN pos > 11 THEN '...' ELSE '' END, array_to_string([CASE WHEN starts_with(lower(x), 'th') THEN '<mark>' || x || '</mark>' ELSE x END FOR x IN w[greatest(pos - 10, 1) : greatest(pos - 10, 1) + 19]], ' '), CASE WHEN greatest(pos - 10, 1) + 20 <= len(w) THEN '...' ELSE '' END) AS snippet FROM h WHERE pos > 0""")
