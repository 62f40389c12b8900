"""Streams: an index that is kept up by changes, and each user's recent visits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioflow.operators.search import postings

SHARDS = 16


def refresh_index(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """changes: a stream of id, content (null: deleted), version. The postings in path (see read_index) follow it, by shards.

    A batch rewrites only the shards of its documents (dynamic partition overwrite), so a repeated batch has no other effect.
    Each shard that is written holds a row without a term, so that one that becomes empty is overwritten too. Of several
    versions of a document in one batch the highest counts (of equal ones the one with the greatest content).
    """

    def apply(batch: DataFrame, _: int) -> None:
        spark: SparkSession = batch.sparkSession
        shard = F.pmod(F.xxhash64("id"), F.lit(SHARDS)).cast("int")
        last = batch.groupBy("id").agg(F.max(F.struct("version", "content")).alias("last"))
        new = last.select("id", "last.content").withColumn("shard", shard)
        fresh = postings(new.filter("content IS NOT NULL").select("id", "content")).withColumn("shard", shard)
        touched = [r[0] for r in new.select("shard").distinct().collect()]  # at most SHARDS
        try:
            old = read_index(spark, path).filter(F.col("shard").isin(touched))
        except Exception as e:  # the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = None
        if old is not None:
            kept = old.join(new.select("id"), "id", "left_anti").select(fresh.columns)
            fresh = fresh.unionByName(kept)
        fresh = fresh.unionByName(new.select("shard").distinct(), allowMissingColumns=True)
        staged = f"{path}-staged"
        fresh.write.mode("overwrite").parquet(staged)  # what is overwritten is also read
        spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """term, id, tf, n, shard of the postings that refresh_index keeps in path."""
    return spark.read.parquet(path).filter("term IS NOT NULL")


def visit_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Visits by user and window of a stream of user_id, ts; late rows up to the watermark count."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last_at")).select(F.col("w.start").alias("start"), "user_id", "n", "last_at")
