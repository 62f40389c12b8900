import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import grids, ordered, quality, relational, search, tree
from folioflow.sources import files
from folioflow.streaming import index


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize(
    ("line", "kind", "id_"),
    [
        ("8.4.7B.2. Title", "sub_article", "8.4.7B.2"),
        ("8.4.6. 0A. Title", "article_0a", "8.4.6.0A"),
        ("8.4.6.2C. Title", "article_suffix", "8.4.6.2C"),
        ("8.4.7B. Title", "alt_subsection", "8.4.7B"),
        ("8.4.7.2. Title", "article", "8.4.7.2"),
        ("8.4.7. Title", "subsection", "8.4.7"),
        ("(2) Clause text", "clause", "2"),
        ("(a) sub", "subclause", "a"),
        ("(iv) sub", "subsubclause", "iv"),
        ("(i) sub", "subclause", "i"),
        ("2012 Building Code", None, None),
        ("17", None, None),
        ("", None, None),
        ("8.4.7. lower", None, None),
    ],
)
def test_line_types(spark, line, kind, id_):
    r = spark.createDataFrame([(line,)], "text string").select(X.line_type(F.col("text")).alias("t"), X.line_id(F.col("text")).alias("i")).first()
    assert (r.t, r.i) == (kind, id_)


@pytest.mark.parametrize(("id_", "kind"), [("9", "part"), ("9.5", "section"), ("8.4.7", "subsection"), ("8.4.7B", "alt_subsection"), ("8.4.6.0A", "article_0a"), ("8.4.6.2C", "article_suffix"), ("8.4.7.2", "article"), ("8.4.7.2.(1)", "clause")])
def test_node_types(spark, id_, kind):
    assert spark.createDataFrame([(id_,)], "id string").select(X.node_type(F.col("id"))).first()[0] == kind


@pytest.mark.parametrize(("id_", "kind"), [(None, "article"), ("", "article"), ("8.4", "article"), ("8.4.7B", "article"), ("8.4.7.0A", "article_0a"), ("8.4.7B.2", "sub_article"), ("8.4.7.2C", "article_suffix"), ("8.4.7B.2C", "article_suffix"), ("8.4.7.2", "article")])
def test_article_types(spark, id_, kind):
    assert spark.createDataFrame([(id_,)], "id string").select(X.article_type(F.col("id"))).first()[0] == kind


@pytest.mark.parametrize(("ref", "kind", "path"), [("9", "part", "/"), ("9.7.2.4.", "article", "/code/9.7.2"), ("9.7.2", "subsection", "/code/9.7.2"), ("9.7", "section", None), ("4.7.2.1", "article", None), ("9", "section", None)])
def test_reference_paths(spark, ref, kind, path):
    assert spark.createDataFrame([(ref, kind)], "r string, k string").select(X.reference_path(F.col("r"), F.col("k"))).first()[0] == path


@pytest.mark.parametrize(("id_", "parent"), [("Table 8.4.7.2", "8.4.7.2"), ("Table 8.4.7.2.-B", "8.4.7.2"), ("Table 8.4.7.2C", "8.4.7.2C"), ("Figure 8.4", None), ("", None)])
def test_table_parents(spark, id_, parent):
    assert spark.createDataFrame([(id_,)], "id string").select(X.table_parent(F.col("id"))).first()[0] == parent


@pytest.mark.parametrize(("text", "there"), [("a = b", True), ("3 / 4 of it", True), ("4 X 10", True), ("SQRT(2)", True), ("12 ft²", True), ("30 °c", True), ("± none", True), ("plain words, 3.4 and (5)", False), ("", False)])
def test_equation_signs(spark, text, there):
    assert spark.createDataFrame([(text,)], "t string").select(X.has_equation(F.col("t"))).first()[0] is there


@pytest.mark.parametrize(
    ("line", "marked", "leveled"),
    [
        ("## 8.4.7.2. **Loads** (See Note A-8.4.) r2", "\n[ARTICLE:8.4.7.2:Loads]", "#### 8.4.7.2. **Loads** (See Note A-8.4.) r2"),
        ("### 8.4.7B.2C.Spans", "\n[ARTICLE:8.4.7B.2C:Spans]", "#### 8.4.7B.2C.Spans"),
        ("8.4.7.2. no heading", "8.4.7.2. no heading", "8.4.7.2. no heading"),
        ("# 8.4.7B. Subsection", "# 8.4.7B. Subsection", "### 8.4.7B. Subsection"),
        ("#### Section 8.4. Rules", "#### Section 8.4. Rules", "## Section 8.4. Rules"),
        ("# <span>8.4.</span> Rules", "# <span>8.4.</span> Rules", "## <span>8.4.</span> Rules"),
        ("# 7.4. Another part", "# 7.4. Another part", "# 7.4. Another part"),
    ],
)
def test_headings(spark, line, marked, leveled):
    r = spark.createDataFrame([(line,)], "t string").select(X.marked_articles(F.col("t")).alias("m"), X.headings_leveled(F.col("t"), "8|9").alias("l")).first()
    assert (r.m, r.l) == (marked, leveled)


def test_sentences_joined(spark):
    text = "of the\nBuilding and\nTable 3 or\nof it\nIt is\nSection"
    assert spark.createDataFrame([(text,)], "t string").select(X.sentences_joined(F.col("t"))).first()[0] == "of the Building and\nTable 3 or\nof it\nIt is\nSection"


def test_open_ancestor_over_pages(spark):
    rows = [(1, 1, 9, "section", "8.4. S"), (1, 2, 1, "subsection", "8.4.7. U"), (1, 2, 2, "clause", "(1) C")]
    df = spark.createDataFrame(rows, "doc int, page int, line int, type string, text string")
    assert values(tree.open_ancestors(df), "type", "parent") == [("clause", "8.4.7. U"), ("section", None), ("subsection", "8.4. S")]


def test_misplaced(spark):
    df = spark.createDataFrame([("a", "clause", "section"), ("b", "clause", "article"), ("c", "part", None), ("d", "x", "y")], "id string, type string, parent_type string")
    assert values(quality.misplaced(df, {"clause": ["article"]}), "id") == [("a",)]


def test_references(spark):
    text = "See Table 9.8.6.4. and Articles 9.3.5.7D, Sentences (2), Section 9.8.6 and Subsection 9.8.6D"
    got = spark.createDataFrame([(text,)], "t string").select(F.explode(X.references(F.col("t"))).alias("r")).select("r.*")
    assert values(got, "type", "target") == [("article", "9.3.5.7D"), ("clause", "2"), ("section", "9.8"), ("subsection", "9.8.6D"), ("table", "9.8.6.4")]


def test_null_and_empty_text(spark):
    df = spark.createDataFrame([(None,), ("",)], "t string")
    for f in (X.fixed, X.superscripts, X.cell_cleaned, X.headings_leveled, X.compared, X.line_type, X.latex):
        assert df.select(f(F.col("t"))).count() == 2


def test_superscripts(spark):
    assert spark.createDataFrame([("a<sup>-12</sup>b<sup>3",)], "t string").select(X.superscripts(F.col("t"))).first()[0] == "a⁻¹²b<sup>3"


def test_markers(spark):
    got = spark.createDataFrame([("x [ARTICLE:9.1:One] body [ARTICLE:9.2:] \n two ",)], "t string").select(F.explode(X.article_markers(F.col("t"))).alias("a")).select("a.*")
    assert values(got, "id", "title") == [("9.1", "One"), ("9.2", "")]


def test_search_scores(spark):
    docs = spark.createDataFrame([("9.5", "Stairs", "stairs and stairs"), ("9.55", "x", "9.5"), ("z", "y", None)], "id string, title string, content string")
    assert values(search.ranked(docs, "9.5"), "id", "score") == [("9.5", 100), ("9.55", 62)]
    assert values(search.ranked(docs, "stairs"), "id", "score") == [("9.5", 44)]
    assert search.ranked(docs, "  ").count() == 0
    assert search.all_terms(docs, "  ").count() == 0


def test_snippet_and_highlight(spark):
    long = "a" * 100 + "Needle" + "b" * 300
    df = spark.createDataFrame([(long,), ("",), ("short",)], "c string")
    got = [r[0] for r in df.select(search.snippet(F.col("c"), "needle")).collect()]
    assert got == ["..." + long[50:250] + "...", "", "short"]
    assert spark.createDataFrame([("The (the)",)], "c string").select(search.highlighted(F.col("c"), "THE")).first()[0] == "**The** (**the**)"


def test_tree(spark):
    rows = [("1", "part", 1, None, "P", None, 1, 1), ("1.2", "section", 1, "1", "S", None, 1, 1), ("1.2.10", "subsection", 1, "1.2", "U", "", 1, 2), ("1.2.9", "subsection", 1, "1.2", "T", "x", 1, 1)]
    nodes = spark.createDataFrame(rows, "id string, type string, part int, parent_id string, title string, content string, page int, seq bigint")
    assert values(tree.breadcrumbs(nodes), "id", "path")[-1] == ("1.2.9", "1/1.2/1.2.9")
    assert values(tree.subtree(nodes, "1.2"), "id", "depth") == [("1.2", 0), ("1.2.10", 1), ("1.2.9", 1)]
    assert [r.block for r in tree.part_roll_up(nodes, ordered=True).collect()] == ["[SECTION:1.2:S]", "[SUBSECTION:1.2.9:T]\n\nx", "[SUBSECTION:1.2.10:U]"]
    assert values(tree.printed(nodes), "line") == [("    1.2.10 [subsection] U",), ("    1.2.9 [subsection] T",), ("  1.2 [section] S",), ("1 [part] P",)]
    assert values(tree.breadcrumbs_by_parent(nodes), "id", "path", "depth") == values(tree.breadcrumbs(nodes), "id", "path", "depth")
    assert tree.node_by_id(nodes, "x").count() == 0
    assert tree.node_by_id(nodes, "7.7").count() == 0
    assert values(tree.flattened(tree.nested(nodes)), "id", "seq") == [("1.2", 1), ("1.2.10", 2), ("1.2.9", 1)]


def test_ordered(spark):
    cells = spark.createDataFrame([(1, 1, 1, None), (1, 2, 1, "a"), (1, 3, 1, " "), (1, 4, 1, "a")], "table_id int, row int, col int, cell string")
    assert [x[1] for x in values(ordered.fill_down(cells), "row", "cell")] == [None, "a", "a", "a"]
    assert [x[1] for x in values(ordered.row_spans(cells), "row", "rowspan")] == [1, 1, 1, 1]
    nums = spark.createDataFrame([("s", 1), ("s", 2), ("s", 5), ("t", 3)], "k string, n int")
    assert values(ordered.gaps(nums, "k", "n"), "after", "missing") == [(2, "3,4")]
    empty = nums.filter("n > 9")
    assert ordered.gaps(empty, "k", "n").count() == 0


def test_grids(spark):
    cells = spark.createDataFrame([(1, 1, 1, "Head"), (1, 1, 2, "B"), (1, 2, 1, "3"), (1, 2, 2, "4.5")], "table_id int, row int, col int, cell string")
    assert grids.header_rows(cells).first().header_rows == 1
    assert grids.html_tables(cells).first().html == "<table><tr><th>Head</th><th>B</th></tr><tr><th>3</th><td>4.5</td></tr></table>"
    assert grids.compared_cells(cells, cells).first().accuracy == 1.0


def test_quality(spark):
    rows = spark.createDataFrame([("a", "**Bold**\n[x](#page-1) \\(y\\)"), ("b", None), ("c", "fine")], "id string, content string")
    assert values(quality.findings(rows), "id", "rule") == [("a", "ESCAPED_PAREN"), ("a", "MD_LINK"), ("a", "RAW_BOLD"), ("b", "EMPTY")]


def test_write_modes(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, p int")
    new = spark.createDataFrame([(2, "B", 2), (3, "C", 2)], "k int, v string, p int")
    assert values(relational.upserted(old, new, "k"), "k", "v") == [(1, "a"), (2, "B"), (3, "C")]
    assert values(relational.merged(old, new, "k"), "k", "action") == [(1, "keep"), (2, "update"), (3, "insert")]
    assert values(relational.inserted_if_absent(old, new, "k"), "k", "v") == [(1, "a"), (2, "b"), (3, "C")]
    assert values(relational.part_replaced(old, new, "p"), "k", "v") == [(1, "a"), (2, "B"), (3, "C")]


def test_files(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"id": "9", "title": "P", "sections": [{"id": "9.1", "title": "S", "subsections": [{"id": "9.1.1", "title": "U", "content": "c"}]}]}')
    assert values(tree.flattened(files.read_parts(spark, f"{tmp_path}/p.json")), "id", "seq") == [("9.1", 1), ("9.1.1", 1)]
    (tmp_path / "t.json").write_text('{"Table 9.1.1.1": {"title": "T", "page": 3, "html": "<table/>"}}')
    assert values(files.read_tables(spark, f"{tmp_path}/t.json"), "id", "page") == [("Table 9.1.1.1", 3)]
    (tmp_path / "m.md").write_text("# a\n\nb")
    assert values(files.read_lines(spark, f"{tmp_path}/m.md"), "pos", "line") == [(0, "# a"), (1, ""), (2, "b")]
    blocks = spark.createDataFrame([(1, 0.0, 100.0, 110.0, "a"), (1, 50.0, 103.0, 110.0, "b"), (1, 0.0, 120.0, 130.0, "c"), (1, 0.0, 10.0, 20.0, "head"), (1, 0.0, 300.0, 310.0, "12")], "page int, x0 double, y0 double, y1 double, text string")
    assert files.text_blocks(blocks, 800.0).first().text == "a\nb\nc"
    assert files.rows_of_blocks(blocks).first().rows == ["head", "a b", "c", "12"]


def test_index_stream(spark, tmp_path):
    src, out, schema = f"{tmp_path}/src", f"{tmp_path}/out", "id string, content string, version long"

    def follow(*rows):
        spark.createDataFrame(rows, schema).write.mode("append").json(src)
        index.refresh_index(spark.readStream.schema(schema).json(src), out, f"{tmp_path}/cp").awaitTermination()
        return values(index.read_index(spark, out), "term", "id", "tf")

    assert follow(("1", "red blue red", 1), ("2", "blue", 1)) == [("blue", "1", 1), ("blue", "2", 1), ("red", "1", 2)]
    assert follow(("1", "green", 2), ("2", None, 2), ("1", "older", 1)) == [("green", "1", 1)]
    assert follow(("1", None, 3)) == []
    assert follow(("3", "", 1), ("4", "new", 1)) == [("new", "4", 1)]
