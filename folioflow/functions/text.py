"""Column functions on code text: line and id types, references, markers, normalisers, annotations.

The patterns are data; functions take and return columns and stay inside the engine's own expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line patterns, first match wins; {P} is the part's number.
LINE_TYPES = [
    ("sub_article", r"^({P}\.\d+\.\d+[A-Z]\.\d+)\.\s+([A-Z].+)$"),
    ("article_0a", r"^({P}\.\d+\.\d+)\.\s*0A\.\s+([A-Z].+)$"),
    ("article_suffix", r"^({P}\.\d+\.\d+\.\d+[A-Z])\.\s+([A-Z].+)$"),
    ("alt_subsection", r"^({P}\.\d+\.\d+[A-Z])\.\s+([A-Z].+)$"),
    ("article", r"^({P}\.\d+\.\d+\.\d+)\.\s+([A-Z].+)$"),
    ("subsection", r"^({P}\.\d+\.\d+)\.\s+([A-Z].+)$"),
    ("clause", r"^\((\d+)\)\s+([A-Z].+)"),
    ("subclause", r"^\(([a-z])\)\s+(.+)"),
    ("subsubclause", r"^\(([ivx]+)\)\s+(.+)"),
]
# Reference patterns; the first group is the target.
REFERENCES = {
    "table": r"Table\s+({P}\.\d+\.\d+\.\d+[A-Z]?)\.?",
    "clause": r"(?:Sentence|Clause)s?\s+\((\d+)\)",
    "article": r"Articles?\s+({P}\.\d+\.\d+\.\d+[A-Z]?)",
    "section": r"Section\s+({P}\.\d+)",
    "subsection": r"Subsection\s+({P}\.\d+\.\d+[A-Z]?)",
}
# Headings and the level of each; an article's heading with its id and title, and what goes from the title.
LEVELS = [(r"^#+\s*{P}\.\d+\.\d+[A-Z]?\.\d+", "####"), (r"^#+\s*{P}\.\d+\.\d+[A-Z]?\.(?!\d)", "###"), (r"^#+\s*(?:Section\s+)?{P}\.\d+\.(?!\d)", "##")]
ARTICLE_HEADING = r"^#{1,4}\s*({P}\.\d+\.\d+[A-Z]?\.\d+[A-Z]?)\.\s*(.+)$"
ARTICLE_TITLE_GONE = [r"\*{1,2}", r"\s*\(See Note[^)]+\)", r"\s*\*{0,2}[er]\d+\*{0,2}$"]
# Page numbers, headers and footers; the mark of a division; an id alone on a line before it.
PAGE_RULES = [r"(?m)^\d+\s*$", r"(?m)^\d{4}\s+Building Code.*$", r"(?m)^Division [ABC]\s*[-–?]\s*Part\s*\d+.*$", r"(?m)^Part 9\s*$", r"(?m)^\d+\s+Division [ABC].*Part\s*\d+.*$"]
DIVISION, RUNNING_ID = r"Division [ABC]\s*[-–]\s*Part", r"(?m)^9\.\d+\.\d+\.\d+[A-Z]?\.\s*$"
# A section's heading at the end of a content; a line with the code of an objective.
SECTION_TAIL = r"\s*Section\s+9\.\d+\.?\s+[A-Z].*$"
OBJECTIVE = r"^#{2,4}\s+\*?\*?([A-Z]{2,3}\d*)\s+(.+?)\*?\*?\s*$"
# Superscript characters.
SUPERSCRIPT = ("0123456789+-", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻")
# Signs of an equation, whatever their case.
EQUATION_SIGNS = [r"[=<>≤≥±]", r"\d+\s*/\s*\d+", "[²³√∑∫∏]", r"\d+\s*[×x]\s*10", r"\bsqrt\s*\(", "m²|m³|ft²|ft³", r"°\s*[CF]"]
# Formula phrases that are typeset, in order.
LATEX = [(r"\bsqrt\(([^)]+)\)", r"\\sqrt{$1}"), (r"<=", r"\\leq "), (r">=", r"\\geq "), (r"\*", r"\\times "), (r"m\^2", "m^{2}")]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once for each row, however often use refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _at(pattern: str, part: str) -> str:
    return pattern.replace("{P}", part)


def _skipped(line: Column) -> Column:
    """Blank lines, numbers and page headers have no type."""
    return (F.trim(line) == "") | line.rlike(r"^\d+$") | line.contains("Building Code") | line.contains("Division B")


def line_type(line: Column, part: str = r"\d+") -> Column:
    """The line's type; null for lines of no type."""
    out = F.when(_skipped(line), F.lit(None).cast("string"))
    for name, pattern in LINE_TYPES:
        out = out.when(line.rlike(_at(pattern, part)), name)
    return out


def line_id(line: Column, part: str = r"\d+") -> Column:
    """What the line's pattern captures first: the id, or the number of a clause."""
    out = F.when(_skipped(line), F.lit(None).cast("string"))
    for name, pattern in LINE_TYPES:
        got = F.regexp_extract(line, _at(pattern, part), 1)
        out = out.when(line.rlike(_at(pattern, part)), F.concat(got, F.lit(".0A")) if name == "article_0a" else got)
    return out


def clause_number(line: Column) -> Column:
    return F.regexp_extract(line, r"^\((\d+)\)", 1).try_cast("int")


def node_type(id_: Column) -> Column:
    """The type that an id's form says (documented meaning: 0A before the letter suffix)."""
    return (
        F.when(id_.rlike(r"^\d+$"), "part").when(id_.rlike(r"^\d+\.\d+$"), "section").when(id_.rlike(r"^\d+\.\d+\.\d+$"), "subsection").when(id_.rlike(r"^\d+\.\d+\.\d+[A-Z]$"), "alt_subsection")
        .when(id_.rlike(r"^\d+\.\d+\.\d+\.0A$"), "article_0a").when(id_.rlike(r"^\d+\.\d+\.\d+\.\d+[A-Z]$"), "article_suffix").when(id_.rlike(r"^\d+\.\d+\.\d+[A-Z]\.\d+$"), "sub_article")
        .when(id_.rlike(r"^\d+\.\d+\.\d+\.\d+$"), "article").when(id_.rlike(r"\(\d+\)$"), "clause").when(id_.rlike(r"\([a-z]\)$"), "subclause").when(id_.rlike(r"\([ivx]+\)$"), "subsubclause")
    )


def article_type(id_: Column) -> Column:
    """An article's type; ids of fewer than four parts, null and empty ones are plain articles."""
    parts = F.split(id_, r"\.")
    last, third = F.element_at(parts, -1), F.try_element_at(parts, F.lit(3))
    letter = "^[0-9]+[A-Za-z]$"
    deep = F.when(last == "0A", "article_0a").when(third.rlike(letter) & last.rlike("^[0-9]+$"), "sub_article").when(last.rlike(letter), "article_suffix")
    return F.coalesce(F.when(F.size(parts) >= 4, deep), F.lit("article"))


def references(text: Column, part: str = "9") -> Column:
    """All references as an array of (type, target), type by type, in order, repeats included."""

    def targets(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(_at(pattern, part)), 1), lambda x: F.struct(F.lit(kind).alias("type"), x.alias("target")))

    found = [targets(kind, p) for kind, p in REFERENCES.items()]
    return F.concat(*found)


def table_id(id_: Column) -> Column:
    """With the word Table before and no dot behind."""
    return F.concat(F.lit("Table "), F.regexp_replace(F.regexp_replace(id_, r"^Table\s+", ""), r"\.$", ""))


def table_parent(id_: Column) -> Column:
    """The article that a table's id names, with its letter, without a suffix after a dash or a last dot."""
    return F.nullif(F.regexp_replace(F.regexp_extract(id_, r"^Table\s+([\d.]+[A-Z]?)", 1), r"\.$", ""), F.lit(""))


def reference_path(ref: Column, kind: Column | None = None) -> Column:
    """The page of a reference: its subsection, for part 9 alone; the part itself is the start page; else null."""
    parts = F.split(F.trim(F.regexp_replace(ref, r"\.$", "")), r"\.")
    page = F.when((F.size(parts) >= 3) & (parts[0] == "9"), F.concat(F.lit("/code/"), F.array_join(F.slice(parts, 1, 3), ".")))
    return page if kind is None else F.when((kind == "part") & (ref == "9"), F.lit("/")).otherwise(page)


def article_markers(content: Column) -> Column:
    """(id, title, body) of each [ARTICLE:id:title] marker; text before the first is left out."""
    parts = F.slice(F.split(content, r"\[ARTICLE:", -1), F.lit(2), F.greatest(F.size(F.split(content, r"\[ARTICLE:", -1)) - 1, F.lit(0)))
    return F.transform(parts, lambda x: F.struct(F.regexp_extract(x, r"^([^:]+):", 1).alias("id"), F.regexp_extract(x, r"^[^:]+:([^\]]*)\]", 1).alias("title"), F.trim(F.regexp_replace(x, r"^[^\]]*\]", "")).alias("body")))


def terms_in(text: Column, terms: list[str]) -> Column:
    """Defined terms in the text, in order, lower-cased; the longest wins; word bounds are ASCII."""
    alternatives = "|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t)))
    return F.transform(F.regexp_extract_all(text, F.lit(rf"(?i)(?<![A-Za-z0-9_])({alternatives})(?![A-Za-z0-9_])"), 1), F.lower)


def has_equation(text: Column) -> Column:
    return text.rlike("(?i)" + "|".join(EQUATION_SIGNS))


# normalisers

def links_unwrapped(text: Column) -> Column:
    return F.regexp_replace(text, r"\[([^\]]+)\]\(#page-\d+[^)]*\)", "$1")


def parens_unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\("), F.lit("(")), F.lit("\\)"), F.lit(")"))


def see_notes_joined(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)(\S)\n+\s*(\(See (?:Note|also)[^)]*\))", "$1 $2")


def emphasis_removed(text: Column) -> Column:
    """Bold, which may run over lines, and italic, which may not."""
    return F.regexp_replace(F.regexp_replace(text, r"\*\*([^*]+)\*\*", "$1"), r"\*([^*\n]+)\*", "$1")


def superscripts(text: Column) -> Column:
    """<sup>digits</sup> as superscript characters."""
    parts = F.split(text, "<sup>", -1)

    def part(x: Column) -> Column:
        end = F.instr(x, "</sup>")
        return F.when(end > 0, F.concat(F.translate(F.substring(x, F.lit(1), end - 1), *SUPERSCRIPT), F.substring(x, end + 6, F.length(x)))).otherwise(F.concat(F.lit("<sup>"), x))

    return F.array_join(F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(part(x))), "")


def newlines_collapsed(text: Column) -> Column:
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def spaces_collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def tags_removed(html: Column) -> Column:
    return F.regexp_replace(html, r"<[^>]*>", "")


def headings_leveled(line: Column, parts: str = "9|10|11|12") -> Column:
    """A heading (a line with #) gets the level of its dotted id: #### article, ### subsection, ## section; tags don't count."""
    bare, out = tags_removed(line), F.when(F.lit(False), line)
    for pattern, level in LEVELS:
        out = out.when(bare.rlike(_at(pattern, f"(?:{parts})")), F.regexp_replace(line, "^#+", level))
    return out.otherwise(line)


def marked_articles(line: Column, part: str = r"\d+") -> Column:
    """An article's heading (a line with 1 to 4 #) as a marker on a line of its own; emphasis, notes and revision marks go."""
    pattern = _at(ARTICLE_HEADING, part)
    title = F.trim(F.regexp_extract(line, pattern, 2))
    for gone in ARTICLE_TITLE_GONE:
        title = F.regexp_replace(title, gone, "")
    marker = F.concat(F.lit("\n[ARTICLE:"), F.regexp_extract(line, pattern, 1), F.lit(":"), F.trim(title), F.lit("]"))
    return F.when(line.rlike(pattern), marker).otherwise(line)


def compared(text: Column) -> Column:
    """For comparison: dashes alike, ½ and ¼ as 1/2 and 1/4, lower case, single spaces."""
    text = F.replace(F.replace(F.translate(text, "–—−", "---"), F.lit("½"), F.lit("1/2")), F.lit("¼"), F.lit("1/4"))
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def cell_cleaned(cell: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(cell, r"\s+", " ")), F.lit(""))


def html_escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def quotes_escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))


def numbers_collapsed(text: Column) -> Column:
    """A section number that is written twice in a row stays once."""
    return F.regexp_replace(text, r"(\d+\.\d+\.\d+\.)\s+\1", "$1")


def latex(text: Column) -> Column:
    out = text
    for pattern, to in LATEX:
        out = F.regexp_replace(out, pattern, to)
    return F.when(has_equation(text), out).otherwise(text)


def sentences_joined(text: Column) -> Column:
    """A line break between a lower-case letter and a capitalised word is a space, unless the word opens a block."""
    return F.regexp_replace(text, r"([a-z])\n(?!Table|Notes|Section|Article|Forming|9\.)([A-Z][a-z]{2,})", "$1 $2")


def table_heading_lines(line: Column) -> Column:
    """A table's heading as lines: id, caption, what it forms part of."""
    return F.regexp_replace(line, r"^(Table \d+(?:\.\d+)+\.?(?:-[A-Z])?)\s+(.*?)(?:\s+(Forming Part of .*))?$", "$1\n$2\n$3")


def fixed(text: Column) -> Column:
    """All content fixes in their order."""
    for f in (links_unwrapped, parens_unescaped, see_notes_joined, superscripts, emphasis_removed, newlines_collapsed):
        text = f(text)
    return text


def page_cleaned(text: Column) -> Column:
    """A page without its number, headers and footers, and without ids alone on a line before the mark of a division."""
    for rule in PAGE_RULES:
        text = F.regexp_replace(text, rule, "")

    def split(t: Column) -> Column:
        at, mark = F.regexp_instr(t, F.lit(DIVISION)), F.regexp_extract(t, DIVISION, 0)
        before = F.regexp_replace(F.substring(t, F.lit(1), at - 1), RUNNING_ID, "")
        return F.when(at > 0, F.concat(before, F.substring(t, at + F.length(mark), F.length(t)))).otherwise(t)

    return F.regexp_replace(F.regexp_replace(bound(text, split), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def section_tail_trimmed(text: Column) -> Column:
    """A content without the heading of the next section in its last line."""
    return F.regexp_replace(text, SECTION_TAIL, "")


def objective_line(line: Column) -> Column:
    """A heading with an objective's code as a bold line after a blank one; other lines as they are."""
    code, title = F.regexp_extract(line, OBJECTIVE, 1), F.regexp_replace(F.trim(F.regexp_extract(line, OBJECTIVE, 2)), r"\*+$", "")
    return F.when(line.rlike(OBJECTIVE), F.concat(F.lit("\n**"), code, F.lit(" "), title, F.lit("**"))).otherwise(line)
