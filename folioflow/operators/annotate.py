"""The annotated reading view: defined terms, and texts cut into layers of annotations that don't overlap.

A layer is a pattern. The first cuts the text into matches and what lies between them, each later one only what is still
plain, so that earlier layers win and word bounds at a cut are bounds. All is done within a row.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.markup import POSITIONAL, between, running_sums
from folioflow.functions.text import bound

# References to notes, and what is set as a formula.
NOTE_REFERENCE = r"\((?i:See\s+Notes?\s+A-[\d.]+(?:\s+and\s+A-[\d.]+)*\.?)\)"
EQUATION = r"\$\$[^$]+\$\$|\$[^$\n]+\$|[≤≥±]|\d+(?:\.\d+)?\s*°\s*[CF]\b|\b(?:mm|m|ft)[²³]|<sup>[^<]*</sup>"
REFERENCE = "|".join(re.sub(r"\((?!\?)(?<!\\\()", "(?:", p) for _, p in POSITIONAL)
#: What matches of these patterns can begin with: other places needn't be tried.
LEADS = {REFERENCE: "[TASCP]", EQUATION: r"[$≤≥±\dmf<]"}
#: Characters of the terms that one pattern holds; more terms are found by a join on their first words.
PATTERN_CHARS = 20_000


def trie_pattern(terms: list[str]) -> str:
    """A pattern of all terms, shared beginnings once, so that a place is tried along one path; the longest one wins."""
    root: dict = {}
    for term in terms:
        at = root
        for c in term:
            at = at.setdefault(c, {})
        at[""] = {}

    def shown(at: dict) -> str:
        parts = [re.escape(c) + shown(below) for c, below in sorted(at.items()) if c]
        if not parts:
            return ""
        body = parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"
        if "" in at:
            return f"{body}?" if len(parts) > 1 else f"(?:{body})?"
        return body

    return shown(root) or r"(?!)"


def term_pattern(terms: list[str]) -> str:
    """Terms as whole words, whatever their case; bounds are those of ASCII words, as in browsers."""
    terms = sorted({t.lower() for t in terms if t})
    firsts = "".join(re.escape(c) for c in sorted({x for t in terms for x in (t[0], t[0].upper()) if len(x) == 1}))
    lead = f"(?=[{firsts}])" if firsts.isascii() and terms else ""  # most places fall to one look at their character
    return rf"{lead}(?<![A-Za-z0-9_])(?i:{trie_pattern(terms)})(?![A-Za-z0-9_])"


def _layer(kind: str, pattern: str) -> Callable[[Column], Column]:
    """A plain part as plain parts and matches, in order."""
    pattern = f"(?={LEADS[pattern]})(?:{pattern})" if pattern in LEADS else pattern

    def parts(x: Column) -> Column:
        part = lambda kind: lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("text"))
        rest = F.transform(between(x["text"], pattern), part(""))

        def merged(found: Column) -> Column:
            both = F.flatten(F.transform(F.arrays_zip(rest.alias("a"), F.transform(found, part(kind)).alias("b")), lambda y: F.array(y["a"], y["b"])))
            return F.when((F.size(found) == 0) & (x["text"] != ""), F.array(x)).otherwise(F.filter(both, lambda y: y.isNotNull() & (y["text"] != "")))

        # most parts hold nothing of a layer: they are read once and stay as they are
        return bound(F.regexp_extract_all(x["text"], F.lit(f"({pattern})"), 1), merged)

    return lambda x: F.when(x["kind"] == "", parts(x)).otherwise(F.array(x))


def cut(text: Column, layers: list[tuple[str, str]]) -> Column:
    """The text as an array of (kind, text), in order; what no layer takes has the kind ''. Null stays null."""
    parts = F.array(F.struct(F.lit("").alias("kind"), text.alias("text")))
    for kind, pattern in layers:
        parts = F.flatten(F.transform(parts, _layer(kind, pattern)))
    return F.when(text.isNotNull(), parts)


def reading_layers(terms: list[str], highlight: str = "") -> list[tuple[str, str]]:
    """References, defined terms, references to notes, the words searched for, formulas."""
    chars = sum(map(len, terms))
    if chars > PATTERN_CHARS:
        raise ValueError(f"{chars} characters of terms; find them with defined_terms, by a join")
    layers = [("reference", REFERENCE), ("definition", term_pattern(terms)), ("note", NOTE_REFERENCE)]
    return [*layers, *([("highlight", f"(?i:{re.escape(highlight)})")] if highlight else []), ("equation", EQUATION)]


def annotations(docs: DataFrame, layers: list[tuple[str, str]]) -> DataFrame:
    """doc, start, end, kind, match of all annotations in docs (doc, content); places from 0, end exclusive."""
    rows = docs.filter("content <> ''").select("doc", cut(F.col("content"), layers).alias("p"))
    rows = rows.withColumn("ends", running_sums(F.transform("p", lambda x: F.length(x["text"]))))
    found = rows.select("doc", F.explode(F.arrays_zip("p", "ends")).alias("x")).filter("x.p.kind <> ''")
    return found.select("doc", (F.col("x.ends") - F.length("x.p.text")).alias("start"), F.col("x.ends").alias("end"), F.col("x.p.kind").alias("kind"), F.col("x.p.text").alias("match"))


_WORD = r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]"


def defined_terms(docs: DataFrame, terms: DataFrame, pattern_chars: int = PATTERN_CHARS) -> DataFrame:
    """Doc, start, end, term of the defined terms (column term) in docs (doc, content), the longest at each place.

    Up to pattern_chars characters of terms go into one pattern. More are found by joining the words of the texts with the
    first words of the terms; those that stand there are then taken from left to right, the longest first. Both ways give
    the same rows: terms are compared in lower case, blank ones are none, and a term must stand between bounds of words.
    """
    terms = terms.select(F.lower("term").alias("term")).filter("term <> ''").distinct()
    if (terms.agg(F.sum(F.length("term"))).first()[0] or 0) <= pattern_chars:
        found = annotations(docs, [("term", term_pattern([r.term for r in terms.collect()]))])
        return found.select("doc", "start", "end", F.lower("match").alias("term"))
    head = lambda x: F.regexp_extract(x, rf"^\s*({_WORD})", 1)
    heads = terms.select(head(F.col("term")).alias("head"), "term", F.length(F.regexp_extract("term", r"^\s*", 0)).alias("lead"))
    rows = docs.filter("content <> ''").select(F.monotonically_increasing_id().alias("row"), "doc", F.lower("content").alias("low"))
    lens = F.regexp_extract_all("low", F.lit(rf"({_WORD})"), 1)
    words = rows.select("row", "doc", "low", lens.alias("w"), F.split("low", _WORD, -1).alias("gap"))
    words = words.withColumn("ends", running_sums(F.transform("w", lambda x, i: F.length(x) + F.length(F.get("gap", i)))))
    words = words.select("row", "doc", "low", F.explode(F.arrays_zip("w", "ends")).alias("x")).select("row", "doc", "low", F.col("x.w").alias("head"), (F.col("x.ends") - F.length("x.w")).alias("at"))
    hits = words.join(heads, "head").withColumn("start", F.col("at") - F.col("lead")).withColumn("end", F.col("start") + F.length("term"))
    hits = hits.filter((F.col("start") >= 0) & (F.expr("substring(low, start + 1, length(term))") == F.col("term")))
    free = lambda at: ~F.coalesce(F.expr(f"substring(low, {at}, 1)"), F.lit("")).rlike("[A-Za-z0-9_]")
    hits = hits.filter((F.col("start") == 0) | free("start")).filter(free("end + 1"))
    longest = hits.groupBy("row", "doc", "start").agg(F.max("end").alias("end"), F.max_by("term", "end").alias("term"))
    # a row's places are as many as its text has words: from left to right, what begins before the last one's end goes
    found = longest.groupBy("row", "doc").agg(F.array_sort(F.collect_list(F.struct("start", "end", "term"))).alias("all"))
    none = F.struct(F.lit(0).alias("upto"), F.array().cast(found.schema["all"].dataType).alias("kept"))
    kept = F.aggregate("all", none, lambda a, x: F.when(x["start"] >= a["upto"], F.struct(x["end"].alias("upto"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a), lambda a: a["kept"])
    return found.select("doc", F.explode(kept).alias("x")).select("doc", "x.start", "x.end", "x.term")
