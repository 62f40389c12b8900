"""Conversion of pages in chunks that can be stopped and taken up again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

CHUNK_PAGES = 100


def done_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunks that the ledger under path says are whole."""
    try:
        return spark.read.schema("chunk long").parquet(f"{path}/ledger").distinct()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "chunk long")


def convert_pages(pages: DataFrame, path: str, convert: Callable[[DataFrame], DataFrame], chunk_pages: int = CHUNK_PAGES, commits: int = 10) -> DataFrame:
    """convert(pages with the column chunk) in at most `commits` jobs; returns all converted rows under path.

    pages have a number in `page`. A chunk's rows are one folder, written whole or over what an earlier, broken run left
    there; after a job the ledger gets its chunks. So a run that was stopped goes on behind its last job, and no page is there
    twice. Rows without a page number are chunk -1. Which chunks are due is found by an anti join; the driver knows only the
    first and the last.
    """
    spark = pages.sparkSession
    numbered = pages.withColumn("chunk", F.coalesce(F.floor(F.col("page") / chunk_pages), F.lit(-1)).cast("long"))
    due = numbered.join(done_chunks(spark, path), "chunk", "left_anti")
    ends = due.agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi")).first()
    if ends.lo is not None:
        step = -(-(ends.hi - ends.lo + 1) // commits)
        for lo in range(ends.lo, ends.hi + 1, step):
            some = due.filter(F.col("chunk").between(lo, lo + step - 1))
            rows = convert(some)
            rows.repartition("chunk").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(f"{path}/pages")
            numbered.filter(F.col("chunk").between(lo, lo + step - 1)).select("chunk").distinct().coalesce(1).write.mode("append").parquet(f"{path}/ledger")
    return spark.read.parquet(f"{path}/pages")
