"""Markdown books, annotations, matching, stored search and chunks against plain versions."""

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from folioflow.functions import text
from folioflow.operators import annotate, grids, markdown, ordered, quality, relational, search, similarity, stemming, tree
from folioflow.plans import registry
from folioflow.plans.catalog import B, M
from folioflow.sources.chunks import convert_pages, done_chunks


def lines(spark, texts, block_lines=3):
    return markdown.text_lines(spark.createDataFrame(list(texts.items()), "doc string, content string"), "doc", "content", block_lines)


def test_last_seen_over_blocks(spark):
    r = random.Random(1)
    rows = [(g, i, r.choice([None, None, None, i])) for g in ("a", "b", None) for i in range(200)]
    df = spark.createDataFrame(rows, "doc string, at int, v int").withColumn("block", F.expr("at div 7"))
    got = {(x.doc, x.at): x.last for x in ordered.last_seen(df, "doc", "block", ["at"], {"last": F.col("v")}).collect()}
    want, last = {}, {}
    for g, i, v in rows:
        last[g] = v if v is not None else last.get(g)
        want[g, i] = last[g]
    assert got == want


BOOK = """preface
## 7.1.1. Early r2
text before
# Section 7.2. Second
lost
#### 7.2.1.1. Lost too
lost
### 7.2.1. **Sub** *one*
own text

#### 7.2.1.2. Art **A** (See Note A-7.)
(1) one
(2) two
#### 7.2.1A.3. Art B e4
### 7.2.1A. Other
x
# Section 7.2. Second
## 7.2.2. Last
#### 7.2.2.1. End"""


def test_import(spark):
    for block_lines in (1, 4, 1000):
        got = [(r.id, r.type, r.parent_id, r.title, r.seq, r.content) for r in markdown.imported(lines(spark, {"b": BOOK, "e": "", "n": None}, block_lines)).orderBy("type", "id", "seq").collect()]
        assert got == [
            ("7.2.1.2", "article", "7.2.1", "Art A", 1, "(1) one\n(2) two"),
            ("7.2.1A.3", "article", "7.2.1", "Art B", 2, None),
            ("7.2.2.1", "article", "7.2.2", "End", 1, None),
            ("7.1", "section", "7", "", 1, None),
            ("7.2", "section", "7", "Second", 2, None),
            ("7.2", "section", "7", "Second", 3, None),
            ("7.1.1", "subsection", "7.1", "Early", 1, "text before"),
            ("7.2.1", "subsection", "7.2", "Sub one", 1, "own text\n"),
            ("7.2.1A", "subsection", "7.2", "Other", 2, "x"),
            ("7.2.2", "subsection", "7.2", "Last", 1, None),
        ]
    assert markdown.imported(lines(spark, {"b": BOOK}), "8").count() == 0


def test_part_slice(spark):
    text = "# Part 1\na\n# Part 2 \nb\n# Section 3.1. C\nc\n# Part 2\nd"
    got = [r.text for r in markdown.part_slice(lines(spark, {"b": text}, 2), 2).orderBy("at").collect()]
    assert got == ["# Part 2 ", "b", "# Part 2", "d"]
    assert [r.text for r in markdown.part_slice(lines(spark, {"b": text}), 3).orderBy("at").collect()] == ["# Section 3.1. C", "c"]


TABLES = """before
### **Table 8.2.1.3.-A Flow rates** Forming Part of Sentences 8.2.1.3.(1), (2)
| A | B |
![](img.png)
|---|---|
| 1 | 2 |
Notes to Table 8.2.1.3.-A:
- (1) one note
 (2)  two
no item
## Heading
between
**Table 8.2.1.4 (Cont'd)**
**Table 8.2.1.5**

**Title of it**
*Forming Part of Sentence 8.2.1.5.(3)*

body
**Table 8.2.1.6** inside
### Table 8.2.1.7 (Cont'd)
### Other
end"""


def test_table_blocks(spark):
    docs = spark.createDataFrame([("d", TABLES), ("n", None), ("e", ""), ("d", TABLES), (None, "**Table 8.2.1.3.-A**")], "doc string, content string")
    got = sorted((r.doc or "", r.id, r.title, r.forming_part, r.body, [tuple(x) for x in r.notes]) for r in markdown.table_blocks(docs).collect())
    one = ("d", "8.2.1.3.-A", "Flow rates", "8.2.1.3.(1), (2)", "| A | B |\n|---|---|\n| 1 | 2 |", [("1", "one note"), ("2", "two")])
    two = ("d", "8.2.1.5", "Title of it", "8.2.1.5.(3)", "body\n**Table 8.2.1.6** inside", [])
    assert got == [("", "8.2.1.3.-A", "", "", "", []), one, one, two, two]
    text = [r.text for r in markdown.exported(markdown.table_blocks(docs)).filter("doc = 'd' AND id = '8.2.1.3.-A'").collect()][0]
    assert text.startswith("#### Table 8.2.1.3.-A Flow rates Forming Part of Sentence 8.2.1.3.(1), (2)\n\n\n\n<table") and text.endswith("\n\n\n\nNotes to Table 8.2.1.3.-A:\n\n\n\n- (1) one note\n\n- (2) two")
    new = spark.createDataFrame([("8.2.1.3.-A", "NEW"), ("8.2.1.3.-A", "NEWER"), ("9.9.9.9", "no")], "id string, text string")
    lo, hi = TABLES.index("### **"), TABLES.index("## Heading")
    got = sorted(((r.doc, r.content) for r in markdown.blocks_replaced(docs, new).collect()), key=repr)
    assert got == sorted([("d", TABLES[:lo] + "NEW\n" + TABLES[hi:])] * 2 + [("n", None), ("e", ""), (None, "NEW")], key=repr)


def test_flat_rows(spark):
    text = "17\nTable 9.1.2.3. T\nForming Part of Sentence (1)\n38 / 89\nWidth of posts\n\nkept\n12\nNotes to Table\n5\n(2) no\nTable 9.1.2.4\n3\n9.1.2.5. Article\n4"
    want = ["17", "Table 9.1.2.3. T", "Forming Part of Sentence (1)", "kept", "Notes to Table", "5", "(2) no", "Table 9.1.2.4", "9.1.2.5. Article", "4"]
    assert [r.text for r in markdown.flat_rows_dropped(lines(spark, {"d": text}, 2)).orderBy("at").collect()] == want


def test_labels(spark):
    text = "[ARTICLE:9.1.1.1:T]\n(1) c\n(a) s\n(ii) r\n- (iv) r\n(B) cap\nwhere\nh = 3 m\n(See Note A-9.)\n(a) s\nx = 3 + 4\nNotes to Table 9.1.1.1.:\n- (1) n\n(a) in notes\nwhere\nh = in notes\n(2) c\n\nh = 4\nlower case\nPlain\n#### Table 9.1.1.2 T\n<table>"
    got = [r.label for r in markdown.labelled(lines(spark, {"d": text}, 4)).orderBy("at").collect()]
    assert got == ["article", "clause", "subclause", "roman", "roman", "capital", "where", "variable", "continuation", "subclause", "equation", "notes", "note_item", "note_text", "where", "note_text", "clause", "equation", "continuation", "text", "table", "table_html"]


def test_numbered_notes(spark):
    text = "(1) before\nNotes to Table 9.1:\n(1) a\n  (2) b\ntext\n- (3) c\n(3) article\n(4) no\nNotes to Table 9.2:\n(5) d\n### end\n(6) no"
    got = [r.text for r in markdown.notes_numbered(lines(spark, {"d": text}, 3)).orderBy("at").collect()]
    assert "\n".join(got) == text.replace("(1) a", "- (1) a").replace("  (2) b", "  - (2) b").replace("(5) d", "- (5) d")


def test_repeated_tables(spark):
    text = "Table 9.1.2.3. A\nx\nTable 9.1.2.3. A\ny\n9.1.2.4. Article\nz\nTable 9.1.2.3.-A\nw\nTable 9.1.2.3\nv"
    got = [r.text for r in markdown.repeated_tables_dropped(lines(spark, {"d": text, "e": "Table 9.1.2.3. A"}, 2)).filter("doc = 'd'").orderBy("at").collect()]
    assert got == ["Table 9.1.2.3. A", "x", "9.1.2.4. Article", "z", "Table 9.1.2.3.-A", "w"]


def test_nearest_below(spark):
    r = random.Random(5)
    titles = [(p, f"t{k:03}", float(r.randint(0, 900))) for p in ("a", "b") for k in range(60)] + [(None, "t", 1.0), ("c", "t", None)]
    found = [(p, f"g{k:03}", float(r.randint(0, 1200))) for p in ("a", "b") for k in range(50)] + [(None, "g", 5.0)]
    want = []
    for page in ("a", "b", None):
        free = sorted((y, g) for p, g, y in found if p == page)
        for y, t in sorted((y, t) for p, t, y in titles if p == page and y is not None):
            best = next(((h, g) for h, g in free if h >= y), None)
            if best and best[0] - y < 40:
                free.remove(best)
                want.append((page, t, best[1]))
    frames = [spark.createDataFrame(rows, f"page string, {n} string, y double") for rows, n in ((titles, "t"), (found, "g"))]
    got = relational.nearest_below(*frames, "page", "t", "g", "y", 40.0).collect()
    assert len(want) > 50 and sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_terms_by_pattern_and_by_join(spark):
    terms = ["fire", "fire separation", "Separation", "a", "load (snow)", "e.g.", "", "x-ray", "firewall"]
    texts = ["Fire separation; firewall, fires. A load (snow) e.g. x-ray", None, "", "fire fire separations SEPARATION_x separation", "é fire Fire\nfire separation"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc int, content string")
    dictionary = spark.createDataFrame([(t,) for t in [*terms, None]], "term string")
    want = []
    longest = "|".join(re.escape(t.lower()) for t in sorted(terms, key=len, reverse=True) if t)
    for d, t in enumerate(texts):
        want += [(d, m.start(), m.end(), m.group().lower()) for m in re.finditer(rf"(?i)(?<![A-Za-z0-9_])({longest})(?![A-Za-z0-9_])", t or "")]
    for chars in (10_000, 0):
        assert sorted(map(tuple, annotate.defined_terms(docs, dictionary, chars).collect())) == sorted(want)


def test_reading_view(spark):
    text = "In Part 9, the fire load (See Note A-9.4.) of Table 9.1.2.3. is ≥ 4 and fire conforms"
    layers = annotate.reading_layers(["fire", "fire load", "table"], "conform")
    got = annotate.annotations(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc int, content string"), layers).orderBy("start").collect()
    assert [(r.kind, r.match) for r in got] == [("reference", "Part 9"), ("definition", "fire load"), ("note", "(See Note A-9.4.)"), ("reference", "Table 9.1.2.3."), ("equation", "≥"), ("definition", "fire"), ("highlight", "conform")]
    assert all(text[r.start : r.end] == r.match for r in got)
    with pytest.raises(ValueError, match="by a join"):
        annotate.reading_layers(["x" * 30_000])


def test_likeness_equals_the_plain_ratio(spark):
    docs = [r.text for r in B(spark, "/root/testdata/sf0.01", "documents").select("text").collect()]
    pairs = [(i, a, b) for i, (a, b) in enumerate(zip(docs, [x.replace("the", "a", 3)[::1] if i % 2 else docs[i - 1] for i, x in enumerate(docs)], strict=True))] + [(-1, None, None), (-2, "a", None)]
    got = {r.id: (r.ratio, r.similar) for r in similarity.dissimilar(spark.createDataFrame(pairs, "id int, content string, source string").repartition(8)).collect()}
    plain = lambda t: re.sub(r"\s+", " ", " ".join(re.split(r"(?<=[.!?])\s+", (t or "").strip(" "))[:2])).strip(" ").translate(str.maketrans("–—‘’“”", "--''\"\"")).lower()
    decided = 0
    for i, a, b in pairs:
        want = difflib.SequenceMatcher(None, plain(a), plain(b)).ratio()
        assert got[i][1] == (want >= 0.8) and (got[i][0] is None or abs(got[i][0] - want) < 1e-6)
        decided += got[i][0] is None
    assert decided > 200


def test_smart_grid_covers_each_place_once(spark):
    cells = M(spark, "/root/testdata/sf0.001", "cells")
    spans = grids.smart_cells(cells, grids.header_rows(cells))
    covered = spans.select("table_id", F.explode(F.sequence("row", F.col("row") + F.col("rowspan") - 1)).alias("row"), "col", "colspan")
    covered = covered.select("table_id", "row", F.explode(F.sequence(F.col("col").cast("long"), F.col("col") + F.col("colspan") - 1)).alias("col"))
    assert covered.count() == covered.distinct().count() == cells.count()


def test_smart_grid(spark):
    rows = [["Head", "A", None, "B"], ["Head", None, "x", "y"], ["r", "1", "2", "<3\uf0b3'"], ["r", "4", None, "6"], [" ", "7", "8", "9"]]
    cells = spark.createDataFrame([(1, i, j, c) for i, row in enumerate(rows, 1) for j, c in enumerate(row, 1)], "table_id int, row int, col int, cell string")
    html = grids.smart_html(cells, spark.createDataFrame([(1, 2)], "table_id int, header_rows int")).first().html.replace("\n", "")
    assert html == '<table class="obc-table" data-table-id="Table 1"><thead><tr><th rowspan="2">Head</th><th colspan="2">A</th><th>B</th></tr><tr><th></th><th>x</th><th>y</th></tr></thead><tbody><tr class="bg-white"><th rowspan="2">r</th><td>1</td><td>2</td><td>&lt;3>=&#x27;</td></tr><tr class="bg-gray-50"><td>4</td><td></td><td>6</td></tr><tr class="bg-white"><th> </th><td>7</td><td>8</td><td>9</td></tr></tbody></table>'


def test_column_clusters(spark):
    words = spark.createDataFrame([(1, 10.0, "a"), (1, 12.0, "b"), (1, 12.0, "c"), (1, 60.0, "d"), (1, 64.9, "e"), (1, 70.0, "f"), (2, 5.0, "g"), (1, None, "h")], "page int, x double, text string")
    got = {r.text: (r.column, r.centre) for r in grids.column_clusters(words, 5.0).collect()}
    assert got == {"a": (1, 11.333333), "b": (1, 11.333333), "c": (1, 11.333333), "d": (2, 62.45), "e": (2, 62.45), "f": (3, 70.0), "g": (1, 5.0)}


def test_added_nodes(spark):
    script = [("subsection", "9.5.3"), ("article", "9.5.3.1"), ("clause", "(1)"), ("subclause", "(a)"), ("subclause", "(b)"), ("clause", "(2)"), ("alt_subsection", "9.5.3A"), ("sub_article", "9.5.3A.1"), ("article", "9.5.3.2"), ("clause", "(1)")]
    rows = [("d", i, t, x, None, "as in Table 9.1.2.3 and Article 9.1.1.1, Table 9.1.2.3" if i == 9 else None) for i, (t, x) in enumerate(script)]
    got = {r.id: (r.parent_id, r.seq, r.refs) for r in tree.added(spark.createDataFrame(rows, "doc string, ord int, type string, id string, title string, content string")).collect()}
    assert got["9.5.3.1"][:2] == ("9.5.3", 1) and got["(a)"][:2] == ("(1)", 1) and got["(b)"][:2] == ("(1)", 2) and got["(2)"][:2] == ("9.5.3.1", 2)
    assert got["9.5.3A"][:2] == ("9.5", 1) and got["9.5.3A.1"][:2] == ("9.5.3A", 1) and got["9.5.3.2"][:2] == ("9.5.3A", 2)
    assert got["(1)"] == ("9.5.3.2", 1, ["9.1.2.3", "9.1.1.1"]) and len(got) == 9


#: Words and stems as published with the rules.
STEMS = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous triplicate triplic formative form formalize formal electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust irritant irrit replacement replac adjustment adjust adoption adopt communism commun activate activ effective effect probate probat rate rate cease ceas controll control roll roll connecting connect connections connect yes ye is is a1b a1b".split()


def test_stems(spark):
    words, want = STEMS[::2], STEMS[1::2]
    rows = spark.createDataFrame([(w,) for w in words], "word string").withColumn("stem", stemming.stem(F.col("word")))
    assert rows.filter("stem IS NULL").count() == 0  # a filter on stems stays small
    got = {r.word: r.stem for r in rows.collect()}
    assert got == dict(zip(words, want, strict=True))


def test_stored_search(spark, tmp_path):
    rows = [("a", "1", "connecting walls and more walls"), ("a", "2", "a wall alone"), ("b", "3", "the wall connects to it"), ("b", "4", "connection, wall; wall")]
    docs = spark.createDataFrame(rows, "part string, id string, content string")
    path = str(tmp_path / "index")
    search.write_search_index(docs, path)
    assert {r.id for r in search.indexed_search(spark, path, "Connect wall").collect()} == {"1", "3", "4"}
    assert search.indexed_search(spark, path, " ; ").count() == 0
    plan = search.indexed_postings(spark, path, search.query_terms(spark, "connect"))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "index").rglob("part=a/**/*.parquet")}
    search.write_search_index(spark.createDataFrame([("b", "5", "walls connect")], docs.schema), path)
    assert {r.id for r in search.indexed_search(spark, path, "connect wall").collect()} == {"1", "5"}
    assert {f: f.stat().st_mtime_ns for f in (tmp_path / "index").rglob("part=a/**/*.parquet")} == files


def test_search_response(spark):
    docs = spark.createDataFrame([("1", "wall", "of brick"), ("2", "roof", "on a wall")], "id string, title string, content string")
    got = search.response(docs, " wall ").first()
    assert (got["query"], got.total, [r.id for r in got.results]) == ("wall", 2, ["1", "2"])
    blank = search.response(docs, "  ").first()
    assert (blank["query"], blank.total, blank.results) == ("", 0, [])


def test_chunks_go_on_after_a_break(spark, tmp_path):
    path = str(tmp_path / "out")
    pages = spark.createDataFrame([(i, f"p{i}") for i in range(95)] + [(None, "x")], "page long, text string")
    calls = []

    def convert(rows):
        calls.append(1)
        if len(calls) == 3:
            return rows.withColumn("text", F.raise_error(F.lit("broken")).cast("string"))
        return rows

    with pytest.raises(Exception, match="broken"):
        convert_pages(pages, path, convert, 10, 4)
    done = {r.chunk for r in done_chunks(spark, path).collect()}
    assert 0 < len(done) < 11
    seen = []
    out = convert_pages(pages, path, lambda rows: seen.append({r.chunk for r in rows.select("chunk").distinct().collect()}) or rows, 10, 4)
    assert not done & set().union(*seen)
    assert sorted((r.page, r.text) for r in out.filter("page IS NOT NULL").collect()) == [(i, f"p{i}") for i in range(95)] and out.count() == 96
    assert convert_pages(pages, path, convert, 10, 4).count() == 96 and len(calls) == 3


def test_sentences(spark):
    text = "lost\n(1) First\n goes on\n\n(a) one,\nmore\n  (b) two\n(2) Second\n(x) odd"
    got = [(r.number, r.letter, r.text) for r in markdown.sentences(lines(spark, {"d": text, "e": "(a) no sentence", "n": None}, 2)).orderBy("place").collect()]
    assert got == [(1, None, "First goes on"), (1, "a", "one, more"), (1, "b", "two"), (2, None, "Second"), (2, "x", "odd")]


def test_slices(spark):
    text = "see 9.1.2. above\n9.1.1. \n  body 9.1.2. inside\n9.1.2. Next"
    rows = [(text, "9.1.1", "9.1.2"), (text, "9.1.2", None), (text, "9.9.9", "9.1.2"), (None, "9.1.1", None), ("9.1.1. a  9.1.2. b", "9.1.1", "9.1.2")]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, a string, b string").coalesce(1).select(markdown.sliced(F.col("t"), F.col("a"), F.col("b"))).collect()]
    assert got == ["9.1.1. \n  body 9.1.2. inside", text[4:], "", None, "9.1.1. a  9.1.2. b"]


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (text.page_cleaned, "12\n9.1.2.3.\nTitle Division B - Part 9\n9.1.2.4.\n2012 Building Code x\n\n\n\nend\nPart 9\n", "Title  9\n9.1.2.4.\n\nend"),
        (text.page_cleaned, "Division B - Part 9\n9.1.2.3.\nno mark", "9.1.2.3.\nno mark"),
        (text.section_tail_trimmed, "a.\nb. Section 9.8. Stairs, Ramps", "a.\nb."),
        (text.section_tail_trimmed, "Section 9.8. Stairs\nb", "Section 9.8. Stairs\nb"),
        (text.objective_line, "## **OS1 Fire Safety**", "\n**OS1 Fire Safety**"),
        (text.objective_line, "## Other", "## Other"),
    ],
)
def test_page_functions(spark, f, given, want):
    got = spark.createDataFrame([(given,), (None,)], "t string").coalesce(1).select(f(F.col("t"))).collect()
    assert [r[0] for r in got] == [want, None]


def test_report(spark):
    rows = spark.createDataFrame([("9.1.1.1", "Scope", 7, "abc", ["A", "B_1"]), ("9.1.1.2", None, None, None, ["C"])], "id string, title string, page int, content string, issues array<string>")
    got = [r.text for r in quality.report(rows).orderBy(F.desc("issues"), "id").collect()]
    assert got == ["9.1.1.1\n  Title: Scope\n  Page: 7\n  Content Length: 3\n  Issues: A, B_1\n\n", "9.1.1.2\n  Title: \n  Page: \n  Content Length: 0\n  Issues: C\n\n"]


def test_unexpected(spark):
    sections = spark.createDataFrame([("9.1", "General Rules", "x" * 100, 3), ("9.2", None, None, 0)], "id string, title string, content string, articles int")
    expected = spark.createDataFrame([("9.1", "general", 3, ["Table 1", "Table 2", "Table 3"]), ("9.2", "Loads", 1, []), ("9.3", "None", 1, ["Table 9"])], "id string, title string, min_articles int, tables array<string>")
    tables = spark.createDataFrame([("Table 1", "h" * 50), ("Table 2", None)], "id string, html string")
    got = sorted(map(tuple, quality.unexpected(sections, expected, tables).collect()))
    assert got == [("9.1", "LITTLE_HTML Table 2"), ("9.1", "NO_TABLE Table 3"), ("9.2", "ARTICLES"), ("9.2", "CONTENT"), ("9.2", "TITLE")]


def test_a_stored_part_is_read_alone(spark):
    plan = registry.queries()["F02_stored_part"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part#\d+ = 3", plan)
