"""Data-quality rules on articles, pages and the tree: one projection makes all findings of a row, then they are exploded."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.markup import places
from folioflow.functions.text import bound
from folioflow.operators.ordered import first_gap

# Fixed values: (rule, level, must match, must not match)
RULES = [
    ("RAW_MARKDOWN_HEADING", "ERROR", r"(?m)^#{2,4}\s+(?!Table\s+\d)", None),
    ("RAW_BOLD", "ERROR", r"(?m)^\*\*[A-Z].*\*\*$", None),
    ("RAW_ITALIC", "WARN", r"(?m)^\*[A-Z].*[^*]\*$", r"(?m)^\*\*"),
    ("FLAT_TABLE", "ERROR", r"(?i)C\.A\.\s*Number.*Division B.*Compliance", r"<table[\s>]"),
    ("FLAT_HI_TABLE", "WARN", r"(?:Small|Medium|Large)\s+(?:Small|Medium|Large)\s+\d", r"(?i)<table[\s>]"),
    ("PDF_HEADER_LEAK", "WARN", r"\d{4}\s+Building Code", None),
    ("RAW_HTML_TAG", "WARN", r"(?i)<(sup|sub|em|strong|b|i)>[^<]*</(sup|sub|em|strong|b|i)>", None),
    ("SEPARATED_CONTINUATION", "WARN", r"\([a-z]\)[^\n]*[,;]\s*\n[a-z]", None),
    ("SEPARATED_SEE_NOTE", "WARN", r"(?i)\n\s*\(See\s+Note\s+[A-Z]?-?\d", None),
    ("DASH_SEE_NOTE", "ERROR", r"(?m)^- \(See Note", None),
    ("BAD_CLAUSE_NUMBER", "ERROR", r"(?m)^- \(\d+\.\d+\)", None),
    ("ORPHAN_DASH_LINE", "WARN", r"(?m)^- [^(A-Za-z]", None),
    ("INLINE_BOLD", "ERROR", r"\(\*\*\d+\)\*\*", None),
    ("INLINE_ITALIC", "WARN", r"(?<!\*)\*[a-zA-Z][^*\n]{1,30}\*(?!\*)", None),
    ("MISSING_SPACE", "ERROR", r"\d\.\d+\.?\d*[A-Z][a-z]", None),
    ("MD_LINK", "ERROR", r"\[([^\]]+)\]\(#page-\d+[^)]*\)", None),
    ("ESCAPED_PAREN", "ERROR", r"\\\([^)]+\\\)", None),
]


def findings(rows: DataFrame) -> DataFrame:
    """id, level, rule of rows (id, content); a row without content has the one finding EMPTY."""
    c = F.col("content")
    tests = []
    for rule, level, must, must_not in RULES:
        hit = c.rlike(must) & ~c.rlike(must_not) if must_not else c.rlike(must)
        tests.append(F.when(hit, F.struct(F.lit(level).alias("level"), F.lit(rule).alias("rule"))))
    count = lambda p: F.regexp_count(c, F.lit(p))
    tests.append(F.when(count(r"Table\s+\d+\.\d+\.\d+\.?\d*-[A-Z]") > count("(?i)<table") + 2, F.struct(F.lit("WARN").alias("level"), F.lit("TABLE_MISMATCH").alias("rule"))))
    tests.append(F.when(count("(?i)<table") != count("(?i)</table>"), F.struct(F.lit("ERROR").alias("level"), F.lit("BROKEN_HTML").alias("rule"))))
    empty = F.array(F.struct(F.lit("WARN").alias("level"), F.lit("EMPTY").alias("rule")))
    all_ = F.when(F.coalesce(c, F.lit("")) == "", empty).otherwise(F.array_compact(F.array(*tests)))
    return rows.select("id", F.explode(all_).alias("f")).select("id", "f.level", "f.rule")


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("rule", "level").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


def passes(found: DataFrame) -> DataFrame:
    return found.groupBy("id").agg(F.bool_and(F.col("level") != "ERROR").alias("passes"))


def screened(rows: DataFrame) -> DataFrame:
    """id, issues (comma-joined) of articles (id, title, content) that look damaged."""
    # what several tests read is worked out once for each row, before them
    rows = rows.select("id", "title", F.coalesce("content", F.lit("")).alias("c"), bound(F.coalesce("content", F.lit("")), lambda c: F.struct(F.trim(c).alias("t"), F.regexp_extract_all(c, F.lit(r"\((\d+)\)"), 1).alias("n"))).alias("x"))
    numbers = F.transform("x.n", lambda x: x.try_cast("decimal(38,0)"))
    rows = rows.select("id", "title", "c", bound(numbers, lambda n: F.struct(F.get(n, F.lit(0)).alias("first"), first_gap(n).alias("gap"))).alias("n"), F.col("x.t").alias("t"), F.regexp_extract("x.t", r"(?<!\S)(\S+)$", 1).alias("word"))
    c, t, gap, word = F.col("c"), F.col("t"), F.col("n.gap"), F.col("word")
    issues: list[Column] = [
        F.when((c == "") & F.col("title").isNotNull() & ~F.col("title").contains("Reserved"), "NO_CONTENT"),
        F.when((c != "") & (F.length(c) < 30) & ~c.rlike("See (Article|Section|Subsection|Note)"), "VERY_SHORT"),
        F.when((F.length(c) > 50) & ~t.startswith("(1)"), "NO_CLAUSE_START"),
        F.when(F.col("n.first") != 1, "CLAUSE_NOT_START_1"),
        F.when(gap.isNotNull(), F.concat(F.lit("CLAUSE_GAP_"), gap)),
        F.when((c != "") & ~t.rlike(r'[.)":]$') & (F.length(word) > 2) & ~word.rlike(r"\d$"), "TRUNCATED_END"),
        F.when((F.length(c) > 200) & c.rlike(r"[A-Z][a-z]?\s*=\s*[A-Za-z0-9+\-*/()]+") & ~F.lower(c).contains("where"), "FORMULA_NO_WHERE"),
    ]
    # a filter on issues would find them a second time
    return rows.select("id", F.explode(F.filter(F.array(F.array_compact(F.array(*issues))), lambda x: F.size(x) > 0)).alias("issues"))


def issue_kinds(screened_: DataFrame) -> DataFrame:
    """How many times each kind (the word before the first underscore) was found."""
    return screened_.select(F.explode("issues").alias("i")).groupBy(F.split("i", "_")[0].alias("kind")).agg(F.count("*").alias("n"))


def unbalanced(pages: DataFrame, tag: str) -> DataFrame:
    opened, closed = F.regexp_count("html", F.lit(rf"(?i)<{tag}[\s>]")), F.regexp_count("html", F.lit(f"(?i)</{tag}>"))
    return pages.select("page_id", opened.cast("long").alias("opened"), closed.cast("long").alias("closed")).filter("opened <> closed")


def rendered(pages: DataFrame, least: int = 500) -> DataFrame:
    """page_id, status: FAIL without a title or when short, WARN without a heading, else PASS."""
    status = F.when(~F.col("html").rlike("(?i)<title>") | (F.length("html") < least), "FAIL").when(~F.col("html").rlike("(?i)<h[12][ >]"), "WARN").otherwise("PASS")
    return pages.select("page_id", status.alias("status"))


def dangling(child: DataFrame, key: str, parent: DataFrame, id_: str) -> DataFrame:
    """The rows of child whose key is set but not among parent's ids."""
    return child.filter(F.col(key).isNotNull()).join(parent.select(F.col(id_).alias("_id")), F.col(key) == F.col("_id"), "left_anti")


def misplaced(nodes: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """The rows (type, parent_type and more) whose parent's type is known and not among those allowed for their type."""
    want = F.create_map(*[x for kind, kinds in allowed.items() for x in (F.lit(kind), F.array(*map(F.lit, kinds)))])[F.col("type")]
    return nodes.filter(want.isNotNull() & F.col("parent_type").isNotNull() & ~F.array_contains(want, F.col("parent_type")))


# What marks an equation to come, what an equation looks like, and starts of lines that may stand alone.
EQUATION_MARKER = r"(?i)(?:calculated as follows|shall be determined by)[:\s]*"
EQUATION = r"[A-Za-z]\s*=\s*[^,\n]{5,}"
LIST_STARTS = "^(?:and|or|the|a) "
# The sections that need an equation where something is calculated, and what counts as one there.
EQUATION_SECTIONS = ["9.4.2", "9.8", "9.25"]
CALCULATED = "shall be calculated"
EQUATION_SIGNS = r"[A-Za-z]+\s*=\s*[\w\s+\-*/()]+|[≤≥×÷√]"
# Fixed values: (issue, pattern) of markup that a normalised text of a part {P} should not have.
MARKUP_LEFT = [
    ("HEADING", r"(?m)^#{1,4}\s+"),
    ("ARTICLE", r"\*\*{P}\.\d+\.\d+\.\d+\."),
    ("BOLD_NUMBER", r"\*\*\(\d+\)\*\*"),
    ("ITALIC", r"(?<!\*)\*[a-zA-Z]{2,20}\*(?!\*)"),
    ("LETTER_MARK", r"(?m)^- \([a-z]\)"),
    ("NUMBER_MARK", r"(?m)^- \(\d+\)"),
]


def _issues(rows: DataFrame, tests: list[tuple[str, Column]]) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in tests]))
    return rows.select("id", F.explode(found).alias("issue"))


def content_checks(rows: DataFrame, least: int = 200) -> DataFrame:
    """id, issue of rows (id, content): too short, a sentence broken off into a line, a letter's clause inside a line.

    With the column section, also: nothing like an equation where one of EQUATION_SECTIONS calculates something.
    """
    c = F.coalesce("content", F.lit(""))
    broken = F.filter(F.regexp_extract_all(c, F.lit(r"\n([a-z][^\n]{10,60})"), 1), lambda x: ~x.rlike(LIST_STARTS))
    tests = [("SHORT", F.length(c) < least), ("SEPARATED", F.size(broken) > 0)]
    for letter in "abc":
        own, cited = rf"(?m)(?:^|\n|:\s*)\({letter}\)", rf"(?i)(?:see|in|under|per)\s+\({letter}\)"
        tests.append((f"INLINE_{letter}", c.contains(f"({letter})") & ~c.rlike(own) & ~c.rlike(cited)))
    if "section" in rows.columns:
        needs = F.coalesce(F.col("section"), F.lit("")).rlike("^(?:" + "|".join(re.escape(x) for x in EQUATION_SECTIONS) + ")")
        tests.append(("NO_EQUATION", needs & F.lower(c).contains(CALCULATED) & ~c.rlike(EQUATION_SIGNS)))
    return _issues(rows, tests)


def equation_markers(rows: DataFrame, reach: int = 200) -> DataFrame:
    """id, markers, missing: how many markers of an equation a text has, and how many have none within `reach` characters."""
    found = places(rows, EQUATION_MARKER)
    bare = ~F.col("content").substr(F.col("end") + 1, F.lit(reach)).rlike(EQUATION)
    return found.groupBy("id").agg(F.count("*").alias("markers"), F.count_if(bare).alias("missing"))


def left_over(rows: DataFrame) -> DataFrame:
    """id, how many page numbers and lone references a text still has, and whether an article's number stands twice in a row."""
    count = lambda p: F.regexp_count("content", F.lit(p)).cast("long")
    return rows.select("id", count(r"(?m)^[ \t]*(?!0{1,3}[ \t]*$)\d{1,3}[ \t]*$").alias("page_numbers"), F.col("content").rlike(r"(9\.\d+\.\d+\.\d+\.)\s*\1").alias("doubled"), count(r"(?m)^[ \t]*9\.\d+\.\d+\.\d*\.?[ \t]*$").alias("orphans"))


def left_over_markup(rows: DataFrame, part: str = r"\d+") -> DataFrame:
    """id, issue for each kind of markup that a text still has."""
    return _issues(rows, [(name, F.col("content").rlike(pattern.replace("{P}", part))) for name, pattern in MARKUP_LEFT])


def report(rows: DataFrame) -> DataFrame:
    """Issues (how many), id, text: the report's block of each row (id, title, page, content, issues).

    The report lists rows with most issues first, those with equally many by id; write it sorted so.
    """
    text = F.concat(F.col("id").cast("string"), F.lit("\n  Title: "), F.coalesce("title", F.lit("")), F.lit("\n  Page: "), F.coalesce(F.col("page").cast("string"), F.lit("")), F.lit("\n  Content Length: "), F.length(F.coalesce("content", F.lit(""))).cast("string"), F.lit("\n  Issues: "), F.array_join("issues", ", "), F.lit("\n\n"))
    return rows.select(F.size("issues").alias("issues"), "id", text.alias("text"))


def unexpected(sections: DataFrame, expected: DataFrame, tables: DataFrame, least: int = 100, least_html: int = 50) -> DataFrame:
    """Id, issue of sections (id, title, content, articles) against expected (id, title, min_articles, tables).

    A title that doesn't hold the expected one, little content, too few articles, a table that isn't there or has little html.
    """
    rows = expected.select("id", F.col("title").alias("_title"), "min_articles", F.col("tables").alias("_tables")).join(sections, "id")
    own = _issues(rows, [("TITLE", ~F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lower("_title"))), ("CONTENT", F.length(F.coalesce("content", F.lit(""))) < least), ("ARTICLES", F.col("articles") < F.col("min_articles"))])
    wanted = expected.join(sections.select("id"), "id", "left_semi").select("id", F.explode("tables").alias("table"))
    found = wanted.join(tables.select(F.col("id").alias("table"), F.lit(True).alias("there"), F.length(F.coalesce("html", F.lit(""))).alias("n")), "table", "left")
    issue = F.when(F.col("there").isNull(), F.concat(F.lit("NO_TABLE "), "table")).when(F.col("n") < least_html, F.concat(F.lit("LITTLE_HTML "), "table"))
    return own.unionByName(found.select("id", issue.alias("issue")).filter("issue IS NOT NULL"))
