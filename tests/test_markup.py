import re

import pytest
from pyspark.sql import functions as F

from folioflow.functions import markup as U
from folioflow.operators import quality

H5 = '<h5 class="table-notes-title">Notes to Table 8.4.7.2.:</h5>'


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (U.clauses_cleaned, "- **(3)** Three\n  - (4) Four\n- (b) b\n- (ii) ii\n- (2.1) x **(9)** y\n- (See Note A-1)\n- . (See Notes A-2)", "(3) Three\n(4) Four\n(b) b\n(ii) ii\n(2.1) x (9) y\n(See Note A-1)\n(See Notes A-2)"),
        (U.clauses_cleaned, f"{H5}\n- (1) kept\n[ARTICLE:8.4.7.3:T]\n- (1) goes", f"{H5}\n- (1) kept\n[ARTICLE:8.4.7.3:T]\n(1) goes"),
        (U.notes_dashed, f"(1) before\n{H5}\n(1) one\n- (2) two\n#### Table 8.4.7.3\n(1) after", f"(1) before\n{H5}\n- (1) one\n- (2) two\n#### Table 8.4.7.3\n(1) after"),
        (U.notes_headings, f"**Notes to Table 8.4.7.2.:**\nNotes to Table 8.4.7.3-B:\n{H5}", f'{H5}\n<h5 class="table-notes-title">Notes to Table 8.4.7.3-B:</h5>\n{H5}'),
        (U.table_headings, "#### Table 8.4.7.2 Loads\n*Forming Part of Sentence (3)*", "#### Table 8.4.7.2 Loads Forming Part of Sentence (3)"),
        (U.table_headings, "### Table 8.4.7.2\n\n**Spans**\n*forming part of it*", "#### Table 8.4.7.2 Spans forming part of it"),
        (U.table_headings, "**Table 8.4.7.2. Nails**", "#### Table 8.4.7.2. Nails"),
        (U.table_headings, '<h4 class="x">Table 8.4.7.2. Panels</h4>', "#### Table 8.4.7.2. Panels"),
        (U.where_blocks, "where:\nQ is the flow\nSs = load\nlonger name = no\n- T = kept\n(1) Q is not", "where,\n- Q = the flow\n- Ss = load\nlonger name = no\n- T = kept\n(1) Q is not"),
        (U.orphan_references_dropped, "a\n9.4.7.2.\n9.4.7.2. to 9.4.7.5.)\n9.4.7.2. text\n", "a\n9.4.7.2. text\n"),
        (U.fragments_merged, "the risk of\nfire.\n.\n(See also Articles 9.1.2.3. and\n9.1.2.4.)", "the risk of fire..\n(See also Articles 9.1.2.3. and 9.1.2.4.)"),
        (U.titles_merged, "9.4.7. Stairs \n  and ramps\nOf houses \nTheir rails\nand posts\n9.4.8. A\nfor b", "9.4.7. Stairs and ramps Of houses\nTheir rails\nand posts\n9.4.8. A for b"),
        (U.table_headings, '<h4 class="x">Table 8.4.7.2</h4>\n<p class="y"><em>Forming Part of Sentence (3)</em></p>\nz', "#### Table 8.4.7.2  Forming Part of Sentence (3)\nz"),
        (U.notes_headings, H5.replace("<h5", '<h5 class="table-notes-title"> <h5') + "</h5>", H5),
        (U.notes_dashed, '<h5 class="table-notes-title">Notes to Table 8.4.7.2.\n(1) not closed', '<h5 class="table-notes-title">Notes to Table 8.4.7.2.\n(1) not closed'),
        (U.clauses_cleaned, '<h5 class="table-notes-title">Notes to Table 8.4.7.2.\n- (1) not closed', '<h5 class="table-notes-title">Notes to Table 8.4.7.2.\n(1) not closed'),
        (U.pipe_tables_converted, "  | A | B |\n  ---|---|\n\t| 1 | 2 |\n|\n|x", '<table class="obc-table"><thead><tr><th>A</th><th>B</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr><tr></tr><tr></tr></tbody></table>'),
        (U.pipe_tables_converted, "|\n|\nx\n| a |\n", "|\n|\nx\n| a |\n"),
        (U.broken_lines_joined, "a wall\nof brick\nwhere x\n(1) b\n- c\n\nd", "a wall of brick\nwhere x\n(1) b\n- c\n d"),
        (U.units_prettified, "5 ° C, 3m² >=2 +/- 1 x<sup>2</sup>", "5°C, 3 m² ≥ 2 ± 1 x²"),
        (U.units_prettified, "$a$ >= 3", "$a$ >= 3"),
        (U.pipe_table_html, "| A | B |\n|---|:-:|\n| 1 |  |", '<table class="obc-table"><thead><tr><th>A</th><th>B</th></tr></thead><tbody><tr><td>1</td><td></td></tr></tbody></table>'),
        (U.pipe_table_html, "| A |", ""),
        (U.pipe_tables_converted, "x\n| A |\n| 1 |\ny\n| alone |\nz", 'x\n<table class="obc-table"><thead><tr><th>A</th></tr></thead><tbody><tr><td>1</td></tr></tbody></table>\ny\n| alone |\nz'),
    ],
)
def test_text(spark, f, text, want):
    assert spark.createDataFrame([(text,), (None,), ("",)], "t string").select(f(F.col("t")).alias("x")).first().x == want


FUNCTIONS = [U.clauses_cleaned, U.notes_dashed, U.notes_headings, U.table_headings, U.where_blocks, U.orphan_references_dropped, U.fragments_merged, U.titles_merged, U.broken_lines_joined, U.units_prettified, U.pipe_tables_converted]


@pytest.mark.parametrize("f", FUNCTIONS)
def test_null_and_empty(spark, f):
    assert [r[0] for r in spark.createDataFrame([(None,), ("",)], "t string").coalesce(1).select(f(F.col("t"))).collect()] == [None, ""]


def test_positional_references(spark):
    text = "In Part 9 see Table 9.4.7.2.-B, Sentence 9.4.7.2.(3) or Clauses; Articles 4.1.2.3. and Section 9.4.7."
    got = U.positional_references(spark.createDataFrame([(1, text), (2, None), (3, "none")], "id int, content string")).orderBy("start").collect()
    assert [(r.type, r.target) for r in got] == [("part", "9"), ("table", "9.4.7.2.-B"), ("sentence", "9.4.7.2.(3)"), ("article", "4.1.2.3."), ("section", "9.4.7.")]
    assert all(text[r.start : r.end] == r.match for r in got)


def test_places_of_rows_that_share_an_id(spark):
    """Places are counted within a row, whatever the rows' ids are; many matches in one text too."""
    many = "ab Part 9, " * 1000
    texts = [(1, "Table 9.1.2.3. x"), (1, "y Part 9 z"), (None, "Part 9"), (None, "in Part 9 or Part 9"), (4, many)]
    got = U.positional_references(spark.createDataFrame(texts, "id int, content string")).collect()
    want = [(i, m.start(), m.end()) for i, t in texts for m in re.finditer(r"Table 9\.1\.2\.3\.|Part 9", t)]
    assert sorted([(r.id, r.start, r.end) for r in got], key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize(("line", "want"), [("9.4.7.", ("subsection", "9.4.7")), ("9.4.7.2. ", ("article", "9.4.7.2")), ("9.4.7B.", ("alt_subsection", "9.4.7B")), ("9.4.7B.2.", ("sub_article", "9.4.7B.2")), ("9.4.7.2C.", ("article_suffix", "9.4.7.2C")), ("9.4.7. Title", None), (None, None)])
def test_id_lines(spark, line, want):
    got = spark.createDataFrame([(line,)], "t string").select(U.id_line(F.col("t")).alias("x")).first().x
    assert (got and tuple(got)) == want


@pytest.mark.parametrize(("title", "want"), [("9.4.7.2C. Loads", ("9.4.7.2C", "Loads")), ("9.4.7. Roofs", ("9.4.7", "Roofs")), ("Section 9.4. Rules", ("9.4", "Rules")), ("Preface", ("", "Preface"))])
def test_titles(spark, title, want):
    assert tuple(spark.createDataFrame([(title,)], "t string").select(U.title_parts(F.col("t")).alias("x")).first().x) == want


def test_checks(spark):
    long = "x" * 200
    rows = spark.createDataFrame([("a", "short (a) in a line"), ("b", long + "\nbroken off from its sentence"), ("c", long + "\n(a) own line, see (b)"), ("d", None)], "id string, content string")
    assert sorted(map(tuple, quality.content_checks(rows).collect())) == [("a", "INLINE_a"), ("a", "SHORT"), ("b", "SEPARATED"), ("d", "SHORT")]
    rows = spark.createDataFrame([("a", "9.8.1", "It shall be calculated. " * 20), ("b", "9.8.1", "It shall be calculated as w = 3 b. " * 20), ("c", "9.7.1", "It shall be calculated. " * 20), ("d", None, "9.8.1 " * 50)], "id string, section string, content string")
    assert sorted(map(tuple, quality.content_checks(rows).collect())) == [("a", "NO_EQUATION")]
    rows = spark.createDataFrame([("a", "calculated as follows: " + "y " * 120 + "x = 12345"), ("b", "shall be determined by x = 3 + abc"), ("c", "none")], "id string, content string")
    assert sorted(map(tuple, quality.equation_markers(rows).collect())) == [("a", 1, 1), ("b", 1, 0)]
    rows = spark.createDataFrame([("a", "17\n000\n9.4.7.2. 9.4.7.2. x\n9.4.7.3.\n")], "id string, content string")
    assert tuple(quality.left_over(rows).first()) == ("a", 1, True, 1)
    rows = spark.createDataFrame([("a", "## H\n**(1)** *word*\n- (a) x\n- (2) y\n**8.4.7.2. T**"), ("b", "plain **bold**")], "id string, content string")
    assert sorted(r.issue for r in quality.left_over_markup(rows, "8").collect()) == ["ARTICLE", "BOLD_NUMBER", "HEADING", "ITALIC", "LETTER_MARK", "NUMBER_MARK"]


def test_marked_snippet(spark):
    text = " ".join(f"w{i}" for i in range(30)) + " Stair here " + " ".join(f"v{i}" for i in range(30))
    got = spark.createDataFrame([(text,), ("none",)], "t string").coalesce(1).select(U.marked_snippet(F.col("t"), "stair", 2, 5)).collect()
    assert [r[0] for r in got] == ["...w28 w29 <mark>Stair</mark> here v0...", None]
