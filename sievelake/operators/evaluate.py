"""Evaluation of findings against gold spans, and the averages of quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ratio(a: str, b: str) -> F.Column:
    return F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))


def evaluate(gold: DataFrame, found: DataFrame) -> DataFrame:
    """Per category precision, recall, f1 and support of exact spans (doc_id, start, end, entity_group), each counted once."""
    key = ["doc_id", "start", "end", "entity_group"]
    both = gold.select(*key).distinct().withColumn("g", F.lit(1)).join(found.select(*key).distinct().withColumn("p", F.lit(1)), key, "full")
    sums = both.groupBy("entity_group").agg(F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count("p").alias("predicted"), F.count("g").alias("support"))
    return scores(sums)


def scores(sums: DataFrame) -> DataFrame:
    """precision, recall and f1 from tp, predicted and support; 0 where a denominator is."""
    p, r = _ratio("tp", "predicted"), _ratio("tp", "support")
    shared = sums.withColumns({"precision": p, "recall": r})
    f1 = F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0))
    return shared.withColumn("f1", f1).select("entity_group", "precision", "recall", "f1", "tp", "predicted", "support")


def averages(classes: DataFrame) -> DataFrame:
    """micro, macro and weighted averages of class rows (precision, recall, f1, support).

    True positives and predictions are recovered from the ratios; macro counts all
    classes alike, those without support too; weighted goes by support.
    """
    tp = F.round(F.col("recall") * F.col("support"))
    predicted = F.when(F.col("precision") > 0, F.round(tp / F.col("precision"))).otherwise(0)
    n = F.nullif(F.sum("support"), F.lit(0))
    parts = classes.agg(
        F.sum(tp).alias("tp"), F.sum(predicted).alias("predicted"), F.sum("support").alias("support"),
        *(F.avg(k).alias(f"macro_{k}") for k in ("precision", "recall", "f1")),
        *((F.sum(F.col(k) * F.col("support")) / n).alias(f"weighted_{k}") for k in ("precision", "recall", "f1")),
    )
    micro = parts.select(F.lit("micro avg").alias("average"), _ratio("tp", "predicted").alias("precision"), _ratio("tp", "support").alias("recall"), F.coalesce(2 * F.col("tp") / F.nullif(F.col("predicted") + F.col("support"), F.lit(0)), F.lit(0.0)).alias("f1"), "support")
    rest = [parts.select(F.lit(f"{k} avg").alias("average"), *(F.coalesce(f"{k}_{x}", F.lit(0.0)).alias(x) for x in ("precision", "recall", "f1")), "support") for k in ("macro", "weighted")]
    return micro.unionByName(rest[0]).unionByName(rest[1])
