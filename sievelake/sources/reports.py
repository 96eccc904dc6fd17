"""Readers of texts and of quality reports, and the writer of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT = "precision double, recall double, f1 double, per_class map<string, struct<precision: double, recall: double, `f1-score`: double, support: long>>"


def read_texts(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Documents of a parquet, json or text source; lines of text files are numbered by file and place."""
    if kind != "text":
        return spark.read.format(kind).load(path)
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("doc_id"), F.col("value").alias("text"))


def read_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """ord, category and prose of a text of numbered descriptions: a line "3. NAME", then lines about it."""
    return parse_descriptions(spark.read.text(path, wholetext=True))


def parse_descriptions(texts: DataFrame) -> DataFrame:
    """The same of whole texts (value)."""
    whole = texts.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^(\d+\.\s+\w+\s*$(?:\R(?!\d+\.\s+\w+\s*$).*)*)"), F.lit(1))).alias("part"))
    head = F.regexp_extract("part", r"^(\d+)\.\s+(\w+)", 1).cast("int")
    prose = F.array_join(F.filter(F.transform(F.split("part", "\n"), lambda x: F.regexp_replace(F.trim(x), r"^- ", "")), lambda x: (x != "") & ~x.rlike(r"^\d+\.\s")), "\n")
    return whole.select(head.alias("ord"), F.regexp_extract("part", r"^(\d+)\.\s+(\w+)", 2).alias("category"), prose.alias("prose"))


def _there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where))


def read_reports(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Quality reports in JSON, by file; broken files give nulls, missing ones no rows."""
    paths = [p for p in paths if _there(spark, p)]
    if not paths:
        return spark.createDataFrame([], f"file string, {REPORT}")
    reader = spark.read.schema(REPORT).option("multiLine", True).option("mode", "PERMISSIVE").option("ignoreMissingFiles", True)
    return reader.json(paths).select(F.col("_metadata.file_path").alias("file"), "precision", "recall", "f1", "per_class")


def parse_reports(texts: DataFrame) -> DataFrame:
    """Quality reports from their JSON texts (file, value); broken ones give nulls."""
    x = F.from_json("value", REPORT)
    return texts.select("file", x.alias("x")).select("file", "x.precision", "x.recall", "x.f1", "x.per_class")


def report_classes(reports: DataFrame) -> DataFrame:
    """One row per class of each report, without its averages."""
    rows = reports.select("file", F.explode("per_class").alias("entity_group", "x")).where(~F.col("entity_group").isin("micro avg", "macro avg", "weighted avg"))
    return rows.select("file", "entity_group", "x.precision", "x.recall", F.col("x.`f1-score`").alias("f1"), "x.support")


def to_result_json(results: DataFrame) -> DataFrame:
    """Each row as JSON text, for sinks that take text."""
    return results.select(F.to_json(F.struct("*")).alias("value"))
