"""Sources and sinks for files: nested part JSON, id-keyed table JSON, markdown lines, JSON and partitioned parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LEAF = "id string, title string"
PART_SCHEMA = f"{_LEAF}, division string, sections array<struct<id: string, title: string, page: int, subsections: array<struct<id: string, title: string, page: int, content: string, articles: array<struct<id: string, title: string, content: string>>>>>>"
TABLE_SCHEMA = "map<string, struct<title: string, page: int, rows: int, cols: int, html: string>>"


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """One row for each part file; the schema is fixed, as optional fields may be absent everywhere."""
    return spark.read.schema(PART_SCHEMA).option("multiLine", True).json(path)


def parts_of(texts: DataFrame) -> DataFrame:
    """The parts in the JSON texts of column value."""
    return texts.select(F.from_json("value", PART_SCHEMA).alias("p")).select("p.*")


def tables_of(texts: DataFrame) -> DataFrame:
    """id and the fields of each entry of the JSON texts of column value, which map table ids to tables."""
    return texts.select(F.explode(F.from_json("value", TABLE_SCHEMA)).alias("id", "t")).select("id", "t.*")


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """id and the fields of each entry of files that map table ids to tables."""
    return tables_of(spark.read.text(path, wholetext=True))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, line of whole text files, in order."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\n", -1)).alias("pos", "line"))


def json_strings(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Distinct matches of a pattern anywhere in JSON files, whatever their structure."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.regexp_extract_all("value", F.lit(f"({pattern})"), 1)).alias("found")).distinct()


def text_blocks(blocks: DataFrame, height: float, margin: float = 60.0) -> DataFrame:
    """page, text of page blocks (page, x0, y0, y1, text), top to bottom, without headers, footers and page numbers."""
    body = blocks.filter((F.col("y0") >= margin) & (F.col("y1") <= height - margin) & ~F.trim("text").rlike(r"^\d{1,3}$"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "text"))), lambda b: b["text"])
    return body.groupBy("page").agg(F.array_join(ordered, "\n").alias("text"))


def rows_of_blocks(blocks: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """page, rows: the blocks of a page grouped by height; a block joins the row whose first block is within tolerance."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col("y0").cast("double").alias("y"), F.col("x0").cast("double").alias("x"), "text")))
    start = F.array().cast("array<struct<y: double, text: string>>")

    def add(rows, b):
        last = F.element_at(rows, -1)
        joined = F.concat(F.slice(rows, F.lit(1), F.size(rows) - 1), F.array(F.struct(last["y"].alias("y"), F.concat(last["text"], F.lit(" "), b["text"]).alias("text"))))
        return F.when((F.size(rows) > 0) & (b["y"] - F.try_element_at(rows, F.lit(-1))["y"] <= tolerance), joined).otherwise(F.concat(rows, F.array(F.struct(b["y"].alias("y"), b["text"].alias("text")))))

    return blocks.groupBy("page").agg(F.transform(F.aggregate(ordered, start, add), lambda r: r["text"]).alias("rows"))


def write_parts(nodes: DataFrame, path: str) -> None:
    """Parquet by part; with dynamic overwriting only the parts that nodes holds are replaced."""
    nodes.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
