"""Quality rules: a threshold table compiled into one Spark projection.

Every feature is a built-in expression, every rule a row of RULES, and the verdict their conjunction. No user function,
no shuffle: one scan. Defined results: a null or empty text has no words and fails; very long texts cost O(n log n) only
where windows repeat; repeated rows are judged alike; other columns of the input pass through unless keep is False.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import carried, texts

# Common function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au aux avec ce dans de des du elle en est et il la le les mais ne pas pour que qui sur un une "
    "als auf aus das dem den der die ein eine für im ist mit nicht sich und von zu "
    "como con del el es las lo los más no para por se su y"
).split()

#: (name, feature, least, most); None: no bound. A row fails a rule when its feature lies outside.
RULES = [
    ("words", "n_words", 20, None),
    ("word_length", "mean_word_chars", 2.0, 12.0),
    ("symbols", "symbol_ratio", None, 0.3),
    ("shouting", "mark_ratio", None, 0.3),
    ("stop_words", "stop_ratio", 0.02, None),
    ("repeated_words", "repeat_ratio", None, 0.3),
    ("repeated_lines", "dup_line_ratio", None, 0.5),
    ("bullet_lines", "bullet_ratio", None, 0.9),
    ("ellipsis_lines", "ellipsis_ratio", None, 0.3),
]

_SPACE = r"[\\x20\\x09-\\x0D]"
_WINDOW = 8


def _ratio(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def features(df: DataFrame) -> DataFrame:
    """df with the columns q (struct of all features) added; text may be null."""
    text = F.coalesce(F.col("text"), F.lit(""))
    cols = df.withColumn("_t", text).withColumn("_w", F.expr(f"filter(split(_t, '{_SPACE}+'), x -> x <> '')"))
    cols = cols.withColumn("_l", F.expr(f"filter(split(_t, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"))
    cols = cols.withColumn("n_words", F.size("_w").cast("long")).withColumn("_h", F.expr("transform(_w, x -> xxhash64(x))"))
    parts = ", ".join(f"_h[i + {k}]" for k in range(_WINDOW))
    cols = cols.withColumn("_win", F.expr(f"CASE WHEN n_words >= {_WINDOW} THEN transform(sequence(0, cast(n_words - {_WINDOW} AS int)), i -> xxhash64({parts})) ELSE array() END"))
    cols = cols.withColumn("_again", F.expr("size(array_distinct(_win)) < size(_win)"))
    cols = cols.withColumn("_sorted", F.expr("CASE WHEN _again THEN array_sort(transform(_win, (h, i) -> struct(h, i))) END"))
    cols = cols.withColumn(
        "_starts",
        F.expr("array_sort(transform(filter(_sorted, (p, j) -> coalesce(p.h = get(_sorted, j - 1).h, false) OR coalesce(p.h = get(_sorted, j + 1).h, false)), p -> p.i))"),
    )
    covered = f"aggregate(_starts, struct(cast(-{_WINDOW} AS int) AS last, 0L AS n), (a, i) -> struct(i AS last, a.n + least({_WINDOW}, i - a.last) AS n)).n"
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    cols = cols.select(
        *df.columns,
        "_t",
        "_l",
        "_w",
        "n_words",
        F.expr(f"length(_t) - regexp_count(_t, '{_SPACE}')").cast("long").alias("word_chars"),
        F.expr(r"regexp_count(_t, '[#*$%&|<>]')").cast("long").alias("n_symbols"),
        F.expr("size(_l) - size(array_distinct(_l))").cast("long").alias("n_dup_lines"),
        F.coalesce(F.expr(covered), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("_n_lines"),
        F.expr("regexp_count(_t, '!!')").cast("long").alias("_marks"),
        F.expr(f"size(filter(_w, x -> lower(x) IN ({stop})))").cast("long").alias("_stops"),
        F.expr(r"size(filter(_l, x -> x rlike '^\\s*[-*•]'))").cast("long").alias("_bullets"),
        F.expr(r"size(filter(_l, x -> x rlike '(\\.\\.\\.|…)\\s*$'))").cast("long").alias("_ellipses"),
    )
    return (
        cols.withColumn("mean_word_chars", _ratio("word_chars", "n_words"))
        .withColumn("symbol_ratio", _ratio("n_symbols", "n_words"))
        .withColumn("mark_ratio", _ratio("_marks", "n_words"))
        .withColumn("stop_ratio", _ratio("_stops", "n_words"))
        .withColumn("repeat_ratio", _ratio("n_repeat_words", "n_words"))
        .withColumn("dup_line_ratio", _ratio("n_dup_lines", "_n_lines"))
        .withColumn("bullet_ratio", _ratio("_bullets", "_n_lines"))
        .withColumn("ellipsis_ratio", _ratio("_ellipses", "_n_lines"))
    )


def compiled(rules: list[tuple] = RULES) -> Column:
    """The names of the rules that a row fails, as an array."""
    tests = []
    for name, feature, least, most in rules:
        bad = F.lit(False)
        if least is not None:
            bad = bad | (F.col(feature) < F.lit(least))
        if most is not None:
            bad = bad | (F.col(feature) > F.lit(most))
        tests.append(F.when(bad, F.lit(name)))
    return F.array_compact(F.array(*tests))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(df: DataFrame, rules: list[tuple] = RULES) -> DataFrame:
    """doc_id, n_words, the four counts, base_failed, kept and the failed rules' names, one row for each row of df."""
    seen = features(texts(df))
    base = base_failed()
    failed = compiled(rules)
    return seen.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base.alias("base_failed"),
        (~base & (F.size(failed) == 0)).alias("kept"),
        failed.alias("failed_rules"),
    )


def keep(df: DataFrame, rules: list[tuple] = RULES) -> DataFrame:
    """The rows of df that pass, with df's columns."""
    # a row number keeps the optimizer from moving the filter below the features, which would compute them many times
    seen = features(carried(df)).select("_row", (~base_failed() & (F.size(compiled(rules)) == 0)).alias("_ok"), F.monotonically_increasing_id().alias("_n"))
    return seen.filter(F.col("_ok") & (F.col("_n") >= 0)).select("_row.*")
