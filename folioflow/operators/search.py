"""Keyword search in its three semantics, snippets, highlighting and the posting lists of the ranked one.

Terms are known when the plan is built, so scoring is one projection and a top-k; BM25 splits each text once and goes on
with the query's own terms alone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from folioflow.operators.stemming import stem
from folioflow.sources.relations import pieces_of


def terms_of(query: str) -> list[str]:
    return query.lower().split()


def occurrences(text: Column, term: str) -> Column:
    return F.regexp_count(text, F.lit(re.escape(term)))


def score(id_: Column, title: Column, content: Column, query: str) -> Column:
    """Sum over terms: id equal 100 or containing 50, title 30, content 10 and 2 for each of up to 5 occurrences."""
    total: Column = F.lit(0)
    i, t, c = F.lower(id_), F.lower(title), F.lower(content)
    for term in terms_of(query):
        total = total + F.when(i == term, 100).when(i.contains(term), 50).otherwise(0) + F.when(t.contains(term), 30).otherwise(0)
        total = total + F.when(c.contains(term), 10 + F.least(occurrences(c, term), F.lit(5)) * 2).otherwise(0)
    return total


def ranked(docs: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """id, score of the best rows of docs (id, title, content); any term suffices; ties by id. A blank query has none."""
    rows = docs.select("id", score(F.col("id"), F.col("title"), F.col("content"), query).cast("long").alias("score"))
    return rows.filter("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def all_terms(docs: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Rows that hold every term; the whole query in the title ranks first (-10), then input order (id)."""
    text = F.lower(F.concat_ws(" ", "title", "content"))
    hit: Column = F.lit(bool(terms_of(query)))
    for term in terms_of(query):
        hit = hit & text.contains(term)
    rank = F.when(F.lower("title").contains(query.lower()), -10).otherwise(0)
    return docs.filter(hit).select("id", "title", F.substring("content", 1, 500).alias("content"), rank.alias("rank")).orderBy("rank", "id").limit(limit)


def snippet(content: Column, query: str, size: int = 200) -> Column:
    """A window of the text around its first hit: 50 characters before, size - 50 after, dots where it is cut."""
    lowered = F.lower(content)
    places = F.filter(F.array(*[F.locate(t, lowered) for t in terms_of(query)] or [F.lit(0)]), lambda x: x > 0)
    m = F.coalesce(F.array_min(places) - 1, F.lit(-1))
    lo, n = F.greatest(F.lit(0), m - 50), F.length(content)
    hi = F.least(n, m + (size - 50))
    cut = F.concat(F.when(lo > 0, F.lit("...")).otherwise(""), F.substring(content, lo + 1, hi - lo), F.when(hi < n, F.lit("...")).otherwise(""))
    plain = F.concat(F.substring(content, 1, size), F.when(n > size, F.lit("...")).otherwise(""))
    return F.when(F.coalesce(content, F.lit("")) == "", F.lit("")).when(m < 0, plain).otherwise(cut)


def highlighted(text: Column, query: str) -> Column:
    for term in terms_of(query):
        text = F.regexp_replace(text, F.lit(f"(?i)({re.escape(term)})"), F.lit("**$1**"))
    return text


def segments(text: Column, term: str) -> Column:
    """How many parts the text falls into when a term's hits stand on their own."""
    return F.size(F.split(text, f"(?i){re.escape(term)}", -1)) + F.regexp_count(text, F.lit(f"(?i){re.escape(term)}"))


def postings(docs: DataFrame) -> DataFrame:
    """term, id, tf, n (the document's words): lower-cased words of [a-z0-9]."""
    words = docs.select("id", F.filter(F.split(F.lower("content"), "[^a-z0-9]+"), lambda x: x != "").alias("w"))
    return words.select("id", F.size("w").alias("n"), F.explode("w").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("n").alias("n"))


def bm25(docs: DataFrame, query: str, limit: int = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id, score of documents that hold all terms (implicit AND). The posting filter runs before the words are counted."""
    terms = sorted(set(re.findall("[a-z0-9]+", query.lower())))
    words = docs.select("id", F.filter(F.split(F.lower("content"), "[^a-z0-9]+"), lambda x: x != "").alias("w")).select("id", F.size("w").alias("n"), F.filter("w", lambda x: x.isin(terms)).alias("w"))
    size = words.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"))
    tf = words.select("id", "n", F.explode("w").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("n").alias("n"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    rows = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(size))  # one row for each query term, and one row
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    total = rows.groupBy("id").agg(F.round(F.sum(part), 6).alias("score"), F.count("*").alias("hit")).filter(F.col("hit") == len(terms))
    return total.select("id", "score").orderBy(F.desc("score"), "id").limit(limit)


#: Files that the postings of a part are dealt to by a hash of their term.
BUCKETS = 32
#: Words whose stems are remembered, and words of documents whose postings a task adds up, sorts and writes.
KNOWN, PIECE_WORDS = 65536, 1_500_000


def words_of(docs: DataFrame) -> DataFrame:
    """docs' columns but content, n (words) and w: the lower-cased words of [a-z0-9]."""
    words = docs.withColumn("w", F.filter(F.split(F.lower("content"), "[^a-z0-9]+"), lambda x: x != ""))
    return words.withColumn("n", F.size("w")).drop("content", "title")


def _counted(docs: DataFrame) -> DataFrame:
    """part, id, n, word, tf of docs: a document's equal words are counted where its text is split; rows aren't moved for it."""
    rows = words_of(docs).select("part", "id", "n", F.sort_array("w").alias("w"))
    starts = F.array_compact(F.transform("w", lambda x, i: F.when((i == 0) | (x != F.get("w", i - 1)), i)))
    rows = rows.withColumn("at", starts)
    counts = F.transform("at", lambda a, i: F.struct(F.get("w", a).alias("word"), (F.coalesce(F.get("at", i + 1), F.size("w")) - a).cast("long").alias("tf")))
    # outer, as Spark else puts the whole expression into a filter too
    return rows.select("part", "id", "n", F.inline_outer(counts)).filter("word IS NOT NULL")


def _frequent(docs: DataFrame) -> DataFrame:
    """word, known: stems of words that occur often, at most KNOWN.

    A document in 16 tells which; all other words are stemmed where they stand, so the choice decides on time alone.
    """
    some = words_of(docs.filter(F.pmod(F.xxhash64("id"), F.lit(16)) == 0)).select(F.explode_outer("w").alias("word"))
    often = some.filter("word IS NOT NULL").groupBy("word").agg(F.count("*").alias("often")).filter("often > 1").orderBy(F.desc("often"), "word").limit(KNOWN)
    return often.select("word", stem(F.col("word")).alias("known"))


def stemmed_postings(docs: DataFrame) -> DataFrame:
    """part, term (a stem), id, tf, n of docs (part, id, content), before those of words with the same stem are added up.

    Frequent words meet their stems in a broadcast of at most KNOWN rows; no words are dealt to tasks by their frequency.
    """
    rows = _counted(docs).join(F.broadcast(_frequent(docs)), "word", "left")
    return rows.select("part", F.coalesce("known", stem(F.col("word"))).alias("term"), "id", "n", "tf")


def bucket(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_search_index(docs: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Postings by part and bucket of the term, and the documents' sizes by part, under path.

    Only the parts that docs holds are written anew, with all their documents; the files of other parts stay. Postings are moved
    once, to the task that adds them up and writes them; a bucket of many documents is dealt to several tasks, a file each.
    """

    def written(rows: DataFrame, name: str, *keys: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{path}/{name}")

    seen = Observation()
    written(words_of(docs).select("part", "id", "n").observe(seen, F.sum("n").alias("words")), "sizes", "part")
    n = pieces_of(docs.sparkSession, seen.get["words"] or 0, PIECE_WORDS)
    found = stemmed_postings(docs).withColumn("bucket", bucket(F.col("term"), buckets)).withColumn("deal", F.pmod(F.xxhash64("id"), F.lit(-(-(n or 1) // (2 * buckets)))))
    found = found.repartition(*[n] * bool(n), "part", "bucket", "deal").groupBy("part", "bucket", "deal", "term", "id", "n").agg(F.sum("tf").alias("tf")).drop("deal")
    written(found.sortWithinPartitions("part", "bucket", "term"), "postings", "part", "bucket")


def query_terms(spark: SparkSession, query: str, buckets: int = BUCKETS) -> list[tuple[str, int]]:
    """The stems of a query's words and their buckets."""
    words = [(w,) for w in sorted(set(re.findall("[a-z0-9]+", query.lower())))]
    rows = spark.createDataFrame(words, "word string").select(stem(F.col("word")).alias("stem")).select("stem", bucket(F.col("stem"), buckets).alias("b")).distinct()
    return sorted((r.stem, r.b) for r in rows.collect()) if words else []


def indexed_postings(spark: SparkSession, path: str, terms: list[tuple[str, int]]) -> DataFrame:
    """The postings of the terms; only the files of their buckets are read."""
    rows = spark.read.parquet(f"{path}/postings")
    return rows.filter(F.col("bucket").isin(sorted({b for _, b in terms}))).filter(F.col("term").isin([t for t, _ in terms]))


def indexed_search(spark: SparkSession, path: str, query: str, limit: int = 20, buckets: int = BUCKETS, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Id, score of the documents of an index that hold all of a query's stems, the best first; ties by id."""
    terms = query_terms(spark, query, buckets)
    if not terms:
        return spark.createDataFrame([], "id string, score double")
    tf = indexed_postings(spark, path, terms)
    size = spark.read.parquet(f"{path}/sizes").agg(F.count("*").alias("docs"), F.avg("n").alias("mean"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    rows = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(size))  # one row for each term of the query, and one row
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    total = rows.groupBy("part", "id").agg(F.round(F.sum(part), 6).alias("score"), F.count("*").alias("hit")).filter(F.col("hit") == len(terms))
    return total.select("id", "score").orderBy(F.desc("score"), "id").limit(limit)


def response(docs: DataFrame, query: str | None, limit: int = 50) -> DataFrame:
    """One row (query, total, results) as the search service answers: the ranked rows (id, score) in order; a blank query has none."""
    query = (query or "").strip()
    rows = ranked(docs, query, limit) if query else docs.select("id", F.lit(0).cast("long").alias("score")).limit(0)
    best = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("by"), "id", "score"))), lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score")))
    return rows.agg(best.alias("results"), F.count("*").alias("total")).select(F.lit(query).alias("query"), "total", "results")
