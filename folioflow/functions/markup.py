"""Column functions on marked-up text: clause lists, table headings, notes, where-blocks, broken lines, units, references.

Each takes the whole text of a document and returns it changed; null stays null, and a text without the forms that a
function looks for stays as it is. Regions (notes of a table) are cut out by splitting at the markers that open them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import bound

# The markers that open a notes region and those that end it.
NOTES = r'<h5 class="table-notes-title">Notes to Table[^<]+</h5>\s*\n'
NOTES_END = [r"\[ARTICLE:", "#### Table"]
# The tags of a notes heading.
H5, H5_END = '<h5 class="table-notes-title">', "</h5>"
# List marks before clauses, in order, and what stays of them.
CLAUSE_RULES = [
    (r"(?m)^\s*-\s*\*{0,2}\((\d+\.\d+)\)\*{0,2}", "($1)"),
    (r"(?m)^\s*-\s*\*{0,2}\((\d+)\)\*{0,2}", "($1)"),
    (r"(?m)^\s*-\s*\(([a-z])\)", "($1)"),
    (r"(?m)^\s*-\s*\(([ivx]+)\)", "($1)"),
    (r"\*{2}\((\d+)\)\*{2}", "($1)"),
    (r"(?m)^- \(See Note", "(See Note"),
    (r"(?m)^- \. \(See Note", "(See Note"),
]
_ID = r"\d+\.\d+\.\d+\.\d+\.?-?[A-Z]?"
# Forms of a table's heading, in order, and the one form they get.
TABLE_RULES = [
    (rf"(#### Table {_ID}[^\n]*)\n+\*([Ff]orming [Pp]art[^*]+)\*", "$1 $2"),
    (rf"<h4[^>]*>Table ({_ID})\s+([^<]+)</h4>", "#### Table $1 $2"),
    (rf"<h4[^>]*>Table ({_ID})\s*([^<]*)</h4>\s*(?:<p[^>]*><em>)?([Ff]orming [Pp]art[^<\n]*)(?:</em></p>)?", "#### Table $1 $2 $3"),
    (rf"### Table ({_ID})\n+\*\*([^*]+)\*\*\n+\*([Ff]orming [Pp]art[^*]+)\*", "#### Table $1 $2 $3"),
    (rf"### Table ({_ID})\n+\*\*([^*]+)\*\*", "#### Table $1 $2"),
    (rf"### \*\*Table ({_ID})\s+([^*]+)\*\*\s*([Ff]orming [Pp]art[^\n]*)", "#### Table $1 $2 $3"),
    (rf"\*\*Table ({_ID})\s+([^*]+)\*\*\s*([Ff]orming [Pp]art[^\n]*)", "#### Table $1 $2 $3"),
    (rf"\*\*Table ({_ID})\s+([^*\n]+)\*\*", "#### Table $1 $2"),
    (rf"(#### Table {_ID}[^\n]*)\n+([Ff]orming [Pp]art of [Ss]entences?\s+[\d.,()and\s]+)", "$1 $2"),
]
# Units and inequalities, in order.
UNIT_RULES = [
    (r"(\d+(?:\.\d+)?)\s*°\s*C\b", "$1°C"),
    (r"(\d+(?:\.\d+)?)\s*°\s*F\b", "$1°F"),
    (r"(\d+(?:\.\d+)?)\s*m²", "$1 m²"),
    (r"(\d+(?:\.\d+)?)\s*m³", "$1 m³"),
    (r"(\d+(?:\.\d+)?)\s*ft²", "$1 ft²"),
    (r"(\d+(?:\.\d+)?)\s*mm²", "$1 mm²"),
    (r"\s*>=\s*", " ≥ "),
    (r"\s*<=\s*", " ≤ "),
    (r"\+/-", "±"),
]
# References by kind; of those that overlap the first counts, of equal starts the kind that stands first.
POSITIONAL = [
    ("table", r"Table\s+(9\.\d+\.\d+\.\d+(?:\.-[A-Z])?\.?)"),
    ("article", r"Articles?\s+(\d+\.\d+\.\d+\.\d+\.?)"),
    ("sentence", r"Sentences?\s+(\d+\.\d+\.\d+\.\d+\.\(\d+\))"),
    ("subsection", r"Subsection\s+(\d+\.\d+\.\d+\.?)"),
    ("section", r"Section\s+(\d+\.\d+\.\d+\.?)"),
    ("clause", r"Clause\s+(\d+\.\d+\.\d+\.\d+\.\(\d+\)\([a-z]\))"),
    ("part", r"Part\s+(9)\b"),
]
# What a section's title looks like, and what a line that goes on with one begins with.
SECTION_TITLE = r"^\d+\.\d+\.\d+\.?\s*\w"
GOES_ON = r"[ \t]*(?i:and|or|in|of|for|to|the|with)[ \t]+\w"
# What a line may begin with, in lower case or not, without being the rest of the line before.
STAYS = r"where\b|[a-zγ]{1,3}\s*=|\[SECTION:|\[ARTICLE:|\[SUBSECTION:|[(\d9A-Z]|</?[a-z]|#{2,4}\s|\*{1,2}[A-Z(]|\s*-\s|\n"
# Lines that are references and nothing else.
ORPHANS = [r"^9\.\d+\.\d+\.\d*\.?$", r"^9\.\d+\.\d+\.\d+\.\s*to\s+9\.\d+\.\d+\.\d+\.\)?$"]
# Rests of a sentence on a line of their own, and what joins them to the line before.
FRAGMENTS = [
    (r"[ \t]*\n[ \t]*([a-z]{1,13}\.)[ \t]*(?=\n|\z)", " $1"),
    (r"[ \t]*\n[ \t]*\.[ \t]*(?=\n|\z)", "."),
    (r"(\(See also[^)\n]*[^)\s])[ \t]*\n[ \t]*([\d.]+\))", "$1 $2"),
]
# A run of two or more lines of a pipe table.
PIPE_TABLE = r"(?m)^(?:[ \t]+\|[^\n]*|\|[^\n]*\|[^\n]*)(?:\n[ \t]*(?:\||[-:][ \t\-:]*\|)[^\n]*)+"
# Lines that hold an id alone.
ID_LINES = [
    ("subsection", r"^(9\.\d+\.\d+)\.\s*$"),
    ("article", r"^(9\.\d+\.\d+\.\d+)\.\s*$"),
    ("alt_subsection", r"^(9\.\d+\.\d+[A-Z])\.\s*$"),
    ("sub_article", r"^(9\.\d+\.\d+[A-Z]\.\d+)\.\s*$"),
    ("article_suffix", r"^(9\.\d+\.\d+\.\d+[A-Z])\.\s*$"),
]
# What a title begins with, its id and its name.
TITLES = [r"^(9\.\d+\.\d+\.\d+[A-Z]?)\.\s*(.+)$", r"^(9\.\d+\.\d+)\.\s*(.+)$", r"^Section\s+(9\.\d+)\.\s*(.+)$"]


def replaced(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, to in rules:
        text = F.regexp_replace(text, pattern, to)
    return text


def _in_notes(text: Column, change) -> Column:
    """change applied to each region from a notes heading up to what ends it."""
    marks = "|".join(f"(?={x})" for x in [NOTES, *NOTES_END])
    return F.array_join(F.transform(F.split(text, marks, -1), lambda x: F.when(x.rlike(f"^{NOTES}"), change(x)).otherwise(x)), "")


def notes_dashed(text: Column) -> Column:
    """In the notes of a table, items (1), (2) begin with a dash."""
    return _in_notes(text, lambda x: F.regexp_replace(x, r"(?m)^(\s*)\((\d+)\)", "$1- ($2)"))


def clauses_cleaned(text: Column) -> Column:
    """Clauses without list marks and bold numbers; the dash of notes' items stays."""
    kept = _in_notes(text, lambda x: F.regexp_replace(x, r"(?m)^- \((\d+)\)", "\u0001($1)"))
    return F.replace(replaced(kept, CLAUSE_RULES), F.lit("\u0001"), F.lit("- "))


def table_headings(text: Column) -> Column:
    """One form for the headings of tables, on one line with what they form part of."""
    return replaced(text, TABLE_RULES)


def notes_headings(text: Column) -> Column:
    """Headings of notes as <h5>, each once; done twice, nothing changes."""
    single = replaced(text, [(rf"({H5})\s*{H5}", "$1"), (rf"(Notes to Table [\d.]+-?[A-Z]?:){H5_END}{H5_END}", f"$1{H5_END}")])
    bold = F.regexp_replace(single, rf"\*\*(Notes to Table {_ID}:)\*\*", "$1")
    return F.regexp_replace(bold, rf"(?<!{H5})(Notes to Table {_ID}:)", f"{H5}$1{H5_END}")


def where_blocks(text: Column) -> Column:
    """After a line "where," each line "X is ..." or "X = ..." up to the next clause, marker or two blank lines is an item."""
    text = F.regexp_replace(text, r"(?m)^where[ \t]*:[ \t]*$", "where,")
    parts = F.split(text, r"(?<=where,)\n", -1)

    def block(x: Column) -> Column:
        end = F.regexp_instr(x, F.lit(r"\n\n\n|\(\d+\)|\([a-z]\)|\[ARTICLE:|#### Table"))
        head = F.when(end > 0, F.substring(x, F.lit(1), end - 1)).otherwise(x)
        return F.concat(F.regexp_replace(head, r"(?m)^[ \t]*([A-Za-zγ]{1,3})[ \t]+(?:is|=)[ \t]+([^\n]*[^\s])[ \t]*$", "- $1 = $2"), F.when(end > 0, F.substring(x, end, F.length(x))).otherwise(""))

    return F.array_join(F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(block(x))), "\n")


def orphan_references_dropped(text: Column) -> Column:
    """Lines that hold a reference and nothing else go."""
    lines = F.split(text, "\n", -1)
    alone = lambda x: F.trim(x).rlike("|".join(ORPHANS))
    return F.array_join(F.filter(lines, lambda x: ~alone(x)), "\n")


def fragments_merged(text: Column) -> Column:
    """A word with a full stop, a full stop, or the end of a bracket on a line of its own joins the line before."""
    return replaced(text, FRAGMENTS)


def titles_merged(text: Column) -> Column:
    """Lines that go on with a title, each beginning with a short word, join the title's line."""
    groups = F.split(text, rf"\n(?!{GOES_ON})", -1)
    title = lambda x: F.trim(F.split(x, "\n", 2)[0]).rlike(SECTION_TITLE)
    joined = lambda x: F.regexp_replace(F.rtrim(x), r"[ \t]*\n[ \t]*", " ")
    return F.array_join(F.transform(groups, lambda x: F.when(x.contains("\n") & title(x), joined(x)).otherwise(x)), "\n")


def broken_lines_joined(text: Column) -> Column:
    """A line that begins in lower case joins the line before, unless it opens a block."""
    return F.regexp_replace(text, rf"\n(?!{STAYS})", " ")


def units_prettified(text: Column) -> Column:
    """Units, degrees and inequalities as they are printed, where no formula is marked by $; and small superscripts."""
    out = F.when(text.rlike(r"\$[^$]+\$"), text).otherwise(replaced(text, UNIT_RULES))
    return replaced(out, [(f"(?i)<sup>{a}</sup>", b) for a, b in zip("23o1", "²³°¹", strict=True)])


def id_line(line: Column) -> Column:
    """(type, id) of a line that holds an id alone, else null."""
    out = F.when(F.lit(False), F.struct(F.lit("").alias("type"), F.lit("").alias("id")))
    for kind, pattern in ID_LINES:
        out = out.when(line.rlike(pattern), F.struct(F.lit(kind).alias("type"), F.regexp_extract(line, pattern, 1).alias("id")))
    return out


def title_parts(title: Column) -> Column:
    """(id, name) of a title; without an id the whole title is the name."""
    out = F.when(F.lit(False), F.struct(F.lit("").alias("id"), F.lit("").alias("name")))
    for pattern in TITLES:
        out = out.when(title.rlike(pattern), F.struct(F.regexp_extract(title, pattern, 1).alias("id"), F.regexp_extract(title, pattern, 2).alias("name")))
    return out.otherwise(F.struct(F.lit("").alias("id"), title.alias("name")))


_RUN = 64


def running_sums(lengths: Column) -> Column:
    """The sums of an array's first 1, 2, ... entries: sums of runs of entries first, then those within a run."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y)
    run = lambda i: F.floor(i / _RUN).cast("int")

    def within(x: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), run(F.size(x) - 1)), lambda k: total(F.slice(x, k * _RUN + 1, F.lit(_RUN))))
        heads = bound(runs, lambda r: F.transform(r, lambda _, k: total(F.slice(r, F.lit(1), k))))
        return bound(heads, lambda h: F.transform(x, lambda _, i: F.get(h, run(i)) + total(F.slice(x, run(i) * _RUN + 1, i % _RUN + 1))))

    return bound(lengths, within)


def between(text: Column, pattern: str) -> Column:
    """What split(text, pattern) gives. Spark compiles the pattern of a split for each value, that of a replacement once; so
    matches become one sign first, unless a text holds that sign."""
    return F.when(F.contains(text, F.lit("\u0003")), F.split(text, pattern, -1)).otherwise(F.split(F.regexp_replace(text, pattern, "\u0003"), "\u0003", -1))


def places(rows: DataFrame, pattern: str) -> DataFrame:
    """id, content, start, end, match of each match in rows (id, content), from 0, end exclusive.

    The parts between the matches are what a split leaves; the places are running sums of both lengths within a row, so
    rows that share an id, or have none, don't meet.
    """

    def ended(m: Column) -> Column:
        lengths = bound(between(F.col("content"), pattern), lambda b: F.transform(m, lambda x, i: F.length(x) + F.length(F.get(b, i))))
        none = F.array().cast("array<struct<m:string,ends:int>>")
        return F.when(F.size(m) > 0, F.zip_with(m, running_sums(lengths), lambda x, e: F.struct(x.alias("m"), e.alias("ends")))).otherwise(none)

    # a filter on the matches would find them a second time
    found = rows.select("id", "content", F.explode(bound(F.regexp_extract_all("content", F.lit(f"({pattern})"), 1), ended)).alias("x"))
    return found.select("id", "content", (F.col("x.ends") - F.length("x.m")).alias("start"), F.col("x.ends").alias("end"), F.col("x.m").alias("match"))


def positional_references(rows: DataFrame) -> DataFrame:
    """Id, start, end, type, target, match of the references in rows (id, content), in order; none overlap.

    One pattern of all kinds finds them from left to right, so an overlapping later one is never met.
    """
    # the first look at a place is at its letter: most go no further
    found = places(rows, "(?=[TASCP])(?:" + "|".join(re.sub(r"\((?!\?)(?<!\\\()", "(?:", p) for _, p in POSITIONAL) + ")")
    said = F.lit(None).cast("struct<type:string,target:string>")
    for name, pattern in reversed(POSITIONAL):
        said = F.when(F.col("match").rlike(f"^{pattern}"), F.struct(F.lit(name).alias("type"), F.regexp_extract("match", pattern, 1).alias("target"))).otherwise(said)
    # exploded, so that a later filter on type or target doesn't find them anew
    return found.select("id", "start", "end", F.explode(F.array(said)).alias("said"), "match").select("id", "start", "end", "said.type", "said.target", "match")


def equations_inserted(text: Column, equations: list[tuple[str, str]]) -> Column:
    """After the first place of each anchor, on a line of its own, its formula; one after the other, in the order given."""
    for anchor, formula in equations:
        at = F.locate(anchor, text)
        upto = at + len(anchor) - 1
        text = F.when(at > 0, F.concat(F.substring(text, F.lit(1), upto), F.lit(f"\n{formula}"), F.substring(text, upto + 1, F.length(text)))).otherwise(text)
    return text


def pipe_table_html(block: Column) -> Column:
    """A pipe table (its lines) as HTML: the first row is the head, a second of dashes goes; '' for less than two lines."""
    lines = F.filter(F.transform(F.split(block, "\n", -1), lambda x: F.trim(x, F.lit(" \t"))), lambda x: x.startswith("|"))
    cells = lambda x: F.transform(F.filter(F.split(x, r"\|", -1), lambda c, i: (i > 0) & (i < F.size(F.split(x, r"\|", -1)) - 1)), lambda c: F.trim(c))
    row = lambda x, tag: F.concat(F.lit("<tr>"), F.array_join(F.transform(cells(x), lambda c: F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    begin = F.when(F.get(lines, F.lit(1)).rlike(r"^\|[\s\-:]+\|"), 3).otherwise(2)
    body = F.transform(F.slice(lines, begin, F.greatest(F.size(lines) - begin + 1, F.lit(0))), lambda x: row(x, "td"))
    html = F.concat(F.lit('<table class="obc-table"><thead>'), row(F.get(lines, F.lit(0)), "th"), F.lit("</thead><tbody>"), F.array_join(body, ""), F.lit("</tbody></table>"))
    return F.when(F.size(lines) < 2, F.lit("")).otherwise(html)


def pipe_tables_converted(text: Column) -> Column:
    """Each run of two or more pipe lines in the text, indented or not, as HTML, in its place."""
    tables = F.concat(F.regexp_extract_all(text, F.lit(f"({PIPE_TABLE})"), 1), F.array(F.lit(None).cast("string")))
    rest = F.split(text, PIPE_TABLE, -1)
    return F.array_join(F.zip_with(rest, tables, lambda x, t: F.concat(x, F.coalesce(pipe_table_html(t), F.lit("")))), "")


def marked_snippet(text: Column, term: str, before: int = 10, words: int = 20) -> Column:
    """About `words` words around the first one that begins with the term, in <mark>, dots where the text goes on."""
    all_ = F.filter(F.split(text, r"\s+", -1), lambda x: x != "")
    hit = F.lower(F.lit(term))
    at = F.array_position(F.transform(all_, lambda x: F.lower(x).startswith(hit)), True).cast("int")
    lo = F.greatest(at - before, F.lit(1))
    part = F.transform(F.slice(all_, lo, F.lit(words)), lambda x: F.when(F.lower(x).startswith(hit), F.concat(F.lit("<mark>"), x, F.lit("</mark>"))).otherwise(x))
    cut = F.concat(F.when(lo > 1, "...").otherwise(""), F.array_join(part, " "), F.when(lo + words <= F.size(all_), "...").otherwise(""))
    return F.when(at > 0, cut)
