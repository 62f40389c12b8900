"""Registered queries on grids: keywords, fill rates, gates, spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.operators import grids as G
from folioflow.operators import ordered as W
from folioflow.plans.catalog import SQL, B, M, add


def _of(name: str) -> str:
    """A registered twin as a relation."""
    return f"({SQL[name]})"


_EXPECTED = lambda s, d: B(s, d, "orders").select(F.col("o_orderkey").alias("table_id"), (F.col("o_custkey") % 7 + 1).alias("rows"), F.lit(4).alias("cols"))
_RATIOS = "0.3 * (least(r, o_custkey % 7 + 1) / greatest(r, o_custkey % 7 + 1)) + 0.3 * (least(c, 4) / greatest(c, 4))"
_SHAPE = ", f AS (SELECT table_id, max(row) AS r, max(col) AS c, avg(CASE WHEN trim(coalesce(cell, '')) <> '' THEN 1.0 ELSE 0.0 END) AS fill FROM cells GROUP BY table_id)"
add("G10_structure_score", lambda s, d: G.structure_score(G.shapes(M(s, d, "cells")).join(G.compared_cells(W.fill_down(M(s, d, "cells")), M(s, d, "cells")).withColumnRenamed("accuracy", "content"), "table_id"), _EXPECTED(s, d)),
    f"{_SHAPE} SELECT f.table_id, round({_RATIOS} + 0.4 * accuracy, 6) AS score FROM f JOIN orders ON o_orderkey = f.table_id JOIN {_of('G09_cell_comparison')} g ON g.table_id = f.table_id", "cells")
add("G18_grid_score", lambda s, d: G.structure_score(G.shapes(M(s, d, "cells")).join(G.fill_rates(M(s, d, "cells")).withColumnRenamed("fill_rate", "content"), "table_id"), _EXPECTED(s, d)),
    f"{_SHAPE} SELECT table_id, round({_RATIOS} + 0.4 * fill, 6) AS score FROM f JOIN orders ON o_orderkey = table_id", "cells")
add("G12_keyword_scores", lambda s, d: G.keyword_scores(M(s, d, "cells"), ["Item A", "same", "49", "absent"], ["item n", "sewage system"]),
    """, t AS (SELECT table_id, string_agg(lower(trim(cell)), ' ' ORDER BY row, col) AS text FROM cells WHERE trim(coalesce(cell, '')) <> '' GROUP BY table_id)
    SELECT table_id, round((contains(text, 'item a')::INT + contains(text, 'same')::INT + contains(text, '49')::INT) / 4, 6) AS score, NOT contains(text, 'item n') AS valid FROM t""", "cells")
add("G19_enough_rows", lambda s, d: G.shapes(M(s, d, "cells")).filter("rows >= 2").select("table_id", "rows"), "SELECT table_id, max(row) AS rows FROM cells GROUP BY table_id HAVING max(row) >= 2", "cells")
add("G20_first_id_on_page", lambda s, d: G.first_ids(M(s, d, "marked"), r"(?i)Table\s+(\d+\.\d+\.\d+\.\d+(?:\.-[A-Z])?)"),
    r"SELECT page, arg_min(id, (doc, line, text)) AS id FROM (SELECT *, regexp_extract(text, '(?i)Table\s+([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+(?:\.-[A-Z])?)', 1) AS id FROM marked) WHERE id <> '' GROUP BY page", "marked")
add("V36_grid_issues", lambda s, d: G.grid_issues(M(s, d, "cells"), 0.3), "SELECT table_id, 'BLANK' AS issue FROM cells GROUP BY table_id HAVING sum(CASE WHEN coalesce(cell, '') = '' THEN 1 ELSE 0 END) > 0.3 * count(*)", "cells")
add("G07_spanned_html", lambda s, d: G.spanned_html(W.spans(M(s, d, "cells")), G.header_rows(M(s, d, "cells"))).select("table_id", F.sha2("html", 256).alias("sha")),
    f""", x AS (SELECT c.table_id, c.row, c.col, cell, rowspan, colspan, header_rows AS h FROM cells c JOIN {_of('W16_row_spans')} a ON a.table_id = c.table_id AND a.row = c.row AND a.col = c.col JOIN {_of('W17_column_spans')} b ON b.table_id = c.table_id AND b.row = c.row AND b.col = c.col
      JOIN {_of('G05_header_rows')} h ON h.table_id = c.table_id WHERE cell IS NOT NULL AND rowspan > 0 AND colspan > 0),
    y AS (SELECT *, CASE WHEN row <= h OR col = 1 THEN 'th' ELSE 'td' END AS tag FROM x),
    r AS (SELECT table_id, row, h, string_agg('<' || tag || CASE WHEN row <= h THEN '' ELSE ' style="text-align: center;"' END || CASE WHEN rowspan > 1 THEN ' rowspan="' || rowspan || '"' ELSE '' END || CASE WHEN colspan > 1 THEN ' colspan="' || colspan || '"' ELSE '' END || '>' || cell || '</' || tag || '>', '' ORDER BY col) AS t FROM y GROUP BY table_id, row, h)
    SELECT table_id, sha256('<table class="obc-table"><thead>' || coalesce(string_agg('<tr>' || t || '</tr>', '' ORDER BY row) FILTER (row <= h), '') || '</thead>'
      || coalesce('<tbody>' || (string_agg(CASE WHEN (row - h) % 2 = 0 THEN '<tr class="bg-gray-50">' ELSE '<tr class="bg-white">' END || t || '</tr>', '' ORDER BY row) FILTER (row > h)) || '</tbody>', '') || '</table>') AS sha FROM r GROUP BY table_id""", "cells")
