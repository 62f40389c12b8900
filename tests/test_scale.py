"""Queries whose work must grow no faster than their input: what the plans hold once, and results on odd rows."""

import re

import pytest
from compare import connection, difference
from pyspark.sql import functions as F

from folioflow.functions import markup
from folioflow.operators import annotate, markdown, ordered, search, similarity, tree
from folioflow.plans import registry
from folioflow.plans.catalog import M
from folioflow.sources import relations


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_likeness_reads_each_text_once(spark):
    rows = spark.createDataFrame([(1, "One. Two. Three.", "ONE. TWO."), (2, "abc. d", "xyz. uvw"), (3, None, None)], "id int, content string, source string")
    found = similarity.dissimilar(rows.repartition(2))
    assert plan(found).count("split(") == 2
    assert sorted(map(tuple, found.collect())) == [(1, 1.0, True), (2, None, False), (3, 1.0, True)]


def test_lines_of_short_texts_meet_no_join(spark, sf):
    rows = spark.createDataFrame([(1, "Notes to Table 9.1.1.1.\n- a\n(1) b"), (2, "\n".join(["Notes to Table 9.1.1.1."] + ["- a"] * 5))], "doc int, content string")
    short = markdown.text_lines(rows, "doc", "content").filter("last_block = 0")
    assert [(r.doc, r.at, r.label) for r in markdown.labelled(short).orderBy("doc", "at").collect()][:3] == [(1, 0, "notes"), (1, 1, "note_item"), (1, 2, "clause")]
    one = sorted(map(tuple, markdown.labelled(markdown.text_lines(rows, "doc", "content", 2)).select("doc", "at", "label").collect()))
    assert one == sorted(map(tuple, markdown.labelled(markdown.text_lines(rows, "doc", "content")).select("doc", "at", "label").collect()))
    assert "Union" in plan(markdown.labelled(short))  # short texts on one side, without the join that long ones need


def test_import_reads_its_lines_once(spark, sf):
    lines = markdown.rendered_lines(M(spark, sf, "nodes"))
    assert "lineitem" not in plan(markdown.imported(lines)) and plan(markdown.imported(lines)).count("Relation") <= 4


def test_patterns_are_tried_once(spark, sf):
    found = {n: plan(registry.queries()[n](spark, sf)) for n in ("T21_linked_references", "N24_units_prettified", "N10_table_headings", "V23_screened_articles")}
    assert found["T21_linked_references"].count("RLIKE") == 7
    assert found["N24_units_prettified"].count("RLIKE") == 1
    assert "Filter" not in found["N10_table_headings"].split("Aggregate")[0]
    assert found["V23_screened_articles"].count("NO_CONTENT") == 1


def test_signs_in_texts_and_between_matches(spark):
    rows = spark.createDataFrame([(1, "a\u0003b Part 9 c"), (2, "Part 9Part 9"), (3, "none"), (4, ""), (5, None)], "id int, content string")
    assert sorted((r.id, r.start, r.end, r.type) for r in markup.positional_references(rows).collect()) == [(1, 4, 10, "part"), (2, 6, 12, "part")]
    view = annotate.annotations(rows.withColumnRenamed("id", "doc"), annotate.reading_layers(["none"]))
    assert sorted((r.doc, r.start, r.kind) for r in view.collect()) == [(1, 4, "reference"), (2, 6, "reference"), (3, 0, "definition")]


def test_slices_of_lines(spark):
    texts = {"a": "head\n1.1. One\n x\n1.2. Two\n1.1. again\n1.9. no id\n\n1.3.\nThree ", "b": "1.2. Other", None: "1.1. Null"}
    lines = markdown.text_lines(spark.createDataFrame(list(texts.items()), "doc string, content string"), "doc", "content", 2).drop("last_block")
    ids = spark.createDataFrame([("a", "1.1"), ("a", "1.2"), ("a", "1.2"), ("a", "1.3"), ("a", "7"), ("b", "1.2"), (None, "1.1")], "doc string, id string")
    got = {(r.doc, r.id): r.part for r in markdown.slices(lines, ids).collect()}
    assert got == {("a", "1.1"): "1.1. One\n x", ("a", "1.2"): "1.2. Two\n1.1. again\n1.9. no id", ("a", "1.3"): "1.3.\nThree", ("a", "7"): "", ("b", "1.2"): "1.2. Other", (None, "1.1"): "1.1. Null"}


def test_slices_gather_no_section(spark, sf):
    assert "regexp_instr" not in plan(registry.queries()["T14_slices"](spark, sf))


def test_spans_read_cells_once(spark):
    """a grid's two spans come from one pass, without joins, and are those of the two operators."""
    from pyspark.sql import functions as F

    from folioflow.operators import ordered as W

    cells = spark.createDataFrame([(t, r, c, v) for t in (1, 2) for r, row in enumerate([["a", None, " "], ["a", "b", None], [None, "b", "b"], ["", "b", "x"]], 1) for c, v in enumerate(row, 1)], "table_id long, row int, col int, cell string")
    found = W.spans(cells)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    keys = ["table_id", "row", "col"]
    joined = cells.join(W.row_spans(cells), keys).join(W.column_spans(cells), keys)
    assert sorted(map(str, found.select(*joined.columns).collect())) == sorted(map(str, joined.collect()))
    assert found.filter(F.col("rowspan") > 1).count() > 0 and found.filter(F.col("colspan") > 1).count() > 0


def test_clause_kinds_need_no_window_of_their_own(spark, sf):
    """a block's kind comes from the scan that numbers the blocks."""
    from __spark_entry__ import queries

    plan = queries()["W06_clause_assembly"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(doc" in plan and "first(type" not in plan


def test_line_types_of_added_nodes_are_worked_out_once(spark, sf):
    """F16: no filter holds the type's expression a second time."""
    from __spark_entry__ import queries

    plan = queries()["H08_added_nodes"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter CASE" not in plan


@pytest.mark.parametrize("name", ["A05_counts", "H19_section_response", "F02_stored_part", "S19_parts_written"])
def test_large_trees_are_dealt_by_their_rows(spark, sf, monkeypatch, name):
    """items are sorted and joined in pieces of so many rows, whatever the session's number of partitions."""
    monkeypatch.setattr(relations, "PIECE_ROWS", 500)
    n = relations.pieces(relations.base(spark, sf, "lineitem"))
    assert n == -(-relations.base(spark, sf, "lineitem").count() // 500) > spark.sparkContext.defaultParallelism
    assert re.search(rf"RepartitionByExpression \[l_orderkey#\d+L?\], {n}\b", plan(M(spark, sf, "nodes")))
    assert difference(spark, name, registry.queries()[name], registry.oracle_sql()[name], sf, connection(sf)) == ""


def test_children_are_counted_in_pieces(spark, sf, monkeypatch):
    """the last sums and their join go by the tree's rows, not by the session's number of partitions."""
    monkeypatch.setattr(relations, "PIECE_ROWS", 500)
    n = -(-sum(relations.base(spark, sf, t).count() for t in ("customer", "orders", "lineitem")) // 500)
    found = registry.queries()["H19_section_response"](spark, sf)
    assert re.search(rf"Aggregate \[parent_id#\d+\].* min\(id#.*\n[^\n]*RepartitionByExpression \[parent_id#\d+\], {n}\b", plan(found))
    assert difference(spark, "H19_section_response", lambda *_: found, registry.oracle_sql()["H19_section_response"], sf, connection(sf)) == ""


def test_children_are_numbered_in_pieces(spark, sf, monkeypatch):
    """the same of the numbers under a parent; the window needs no shuffle of its own."""
    monkeypatch.setattr(relations, "PIECE_ROWS", 500)
    n = relations.tree_pieces(spark, sf)
    found = registry.queries()["H07_child_sequence"](spark, sf)
    made = found._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"hashpartitioning\(_p#\d+, (\d+)\), (\w+)", made) == [(str(n), "REPARTITION_BY_NUM")]
    assert difference(spark, "H07_child_sequence", lambda *_: found, registry.oracle_sql()["H07_child_sequence"], sf, connection(sf)) == ""


def test_pieces_leave_a_section_as_it_was(spark):
    """sections that share an id, without an id or children, children without an id, and one section that holds most."""
    rows = [("1", "part", None, "P"), ("1.1", "section", "1", "S"), ("1.1", "section", "1", "again"), ("1.2", "section", "1", None), (None, "section", "1", "no id"), (None, "subsection", "1.2", "T"), ("x", "clause", None, "lost")]
    rows += [(f"1.1.{i}", "article", "1.1", "A") for i in range(10, 400)]
    nodes = spark.createDataFrame(rows, "id string, type string, parent_id string, title string")
    tables = spark.createDataFrame([("t", "1.2"), ("u", "1.2"), ("v", None), ("w", "9.9")], "id string, parent_id string")
    want = sorted([("1.1", "S", 390, "1.1.10", 0, "1/1"), ("1.1", "again", 390, "1.1.10", 0, "1/1"), ("1.2", None, 1, None, 2, "1/2"), (None, "no id", 0, None, 0, None), (None, "T", 0, None, 0, None)], key=repr)
    for n in (None, 1, 9):
        got = tree.section_view(nodes, tables, n).collect()
        assert sorted([(r.id, r.title, r.n_children, r.first_child, r.n_tables, r.breadcrumb) for r in got], key=repr) == want


def test_distinct_ids_are_counted_in_pieces(spark, sf, monkeypatch):
    """no task gathers ids before they are dealt."""
    monkeypatch.setattr(relations, "PIECE_ROWS", 500)
    found = registry.queries()["A05_counts"](spark, sf)
    assert "RepartitionByExpression [id#" in plan(found)


def test_postings_are_moved_once(spark, tmp_path, monkeypatch):
    """no shuffle by words, texts are split once for the postings, and pieces leave them as they were."""
    texts = [("a", "1", "Walls wall, connected WALL connects"), ("a", "2", ""), ("a", "3", None), ("b", "4", "x2 of 12 of"), ("b", "4", "x2 of 12 of"), ("b", "5", " ".join(["wall"] * 300 + ["Running runs"] * 2)), ("b", None, "wall")]
    docs = spark.createDataFrame(texts, "part string, id string, content string")
    moved = plan(search.stemmed_postings(docs))
    assert moved.count("Join") == 1 and "Join LeftOuter" in moved and moved.count("Aggregate") == 1
    want = {("a", "wall", "1", 3, 5), ("a", "connect", "1", 2, 5), ("b", "x2", "4", 2, 4), ("b", "of", "4", 4, 4), ("b", "12", "4", 2, 4), ("b", "wall", "5", 300, 304), ("b", "run", "5", 4, 304), ("b", "wall", None, 1, 1)}
    for i, size in enumerate((1_500_000, 3, 1)):
        monkeypatch.setattr(search, "PIECE_WORDS", size)
        search.write_search_index(docs, f"{tmp_path}/{i}")
        rows = spark.read.parquet(f"{tmp_path}/{i}/postings").collect()
        assert len(rows) == len(want) and {(r.part, r.term, r.id, r.tf, r.n) for r in rows} == want


@pytest.mark.parametrize("name", ["K03_stemmed_search", "K10_part_refreshed"])
def test_an_index_in_pieces_holds_the_same(spark, sf, monkeypatch, name):
    monkeypatch.setattr(search, "PIECE_WORDS", 8000)
    assert difference(spark, name, registry.queries()[name], registry.oracle_sql()[name], sf, connection(sf)) == ""


def test_a_book_is_scanned_in_runs_of_subsections(spark, sf, monkeypatch):
    """a section's length doesn't bound what a task sorts; runs keep the book's order."""
    from folioflow.plans import catalog_books

    assert difference(spark, "T15_part_slice", registry.queries()["T15_part_slice"], registry.oracle_sql()["T15_part_slice"], sf, connection(sf)) == ""
    ids = [(1, "1"), (1, "1.1"), (1, "1.1.5"), (1, "1.1.9000"), (1, "1.2"), (2, "2"), (2, "2.1"), (2, "2.1.8191"), (2, "2.1.8192"), (2, "2.1.8192.4"), (3, "3")]
    nodes = spark.createDataFrame([(p, ("part", "section", "subsection", "article")[i.count(".")], i, "t", None) for p, i in ids], "part int, type string, id string, title string, content string")
    monkeypatch.setattr(catalog_books, "M", lambda *_: nodes)
    got = markdown.part_slice(catalog_books._ONE_BOOK(spark, sf), 2)
    assert catalog_books._ONE_BOOK(spark, sf).filter("size(block) = 3").select("block").distinct().count() == 4
    assert sorted(r.text.split()[-2] if "." in r.text else r.text for r in got.collect()) == ["# Part 2", "2.1.", "2.1.8191.", "2.1.8192.", "2.1.8192.4."]
