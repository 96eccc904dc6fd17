"""Merging of overlapping findings, as islands of windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge(found: DataFrame) -> DataFrame:
    """Joins findings that follow each other in a document, overlap and have one category.

    By start, then seq, a finding joins the one before it if it starts before that
    one's end and has its category; a finding of another category in between ends a
    run. The merged one has the largest end and score, the last word, and all
    methods joined by +. Returns doc_id, seq (in the new order), entity_group, word,
    start, end, score, method. All windows share one partitioning by doc_id.
    """
    order = Window.partitionBy("doc_id").orderBy("start", "seq")
    placed = found.select("doc_id", "entity_group", "word", "start", "end", "score", "method", F.row_number().over(order).alias("ord"))
    by = Window.partitionBy("doc_id").orderBy("ord")
    change = (~F.col("entity_group").eqNullSafe(F.lag("entity_group").over(by))).cast("int")
    runs = placed.withColumn("run", F.sum(change).over(by))
    before = Window.partitionBy("doc_id", "run").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    broken = runs.withColumn("reach", F.max("end").over(before)).withColumn("brk", (F.col("reach").isNull() | (F.col("start") >= F.col("reach"))).cast("int"))
    islands = broken.withColumn("island", F.sum("brk").over(by))
    methods = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "method"))), lambda x: x["method"]), "+")
    merged = islands.groupBy("doc_id", "island").agg(
        F.first("entity_group").alias("entity_group"), F.max_by("word", "ord").alias("word"), F.min("start").alias("start"),
        F.max("end").alias("end"), F.max("score").alias("score"), methods.alias("method"),
    )
    return merged.select("doc_id", (F.col("island") - 1).cast("int").alias("seq"), "entity_group", "word", "start", "end", "score", "method")
