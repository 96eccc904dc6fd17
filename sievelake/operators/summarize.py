"""Summaries of findings, by document and over the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _set(value: Column) -> Column:
    return F.array_sort(F.collect_set(value))


def summary_by_document(docs: DataFrame, judged: DataFrame, loaded: tuple[str, ...] = ()) -> DataFrame:
    """One row per document of docs (doc_id) for its findings with a status; zeros for those without any.

    Columns: doc_id, total_entities, filtered_entities, categories_found (of valid
    ones), methods_used (of all, before filtering, and the models that are loaded, with
    or without findings), avg_confidence (of valid ones), validation_rate.
    """
    valid = F.col("status") == "VALID"
    sums = judged.groupBy("doc_id").agg(
        F.count_if(valid).alias("total_entities"), F.count_if(~valid).alias("filtered_entities"), _set(F.when(valid, F.col("entity_group"))).alias("categories_found"),
        _set(F.when(F.col("method") == "contextual", "contextual").when(F.col("method").startswith("regex"), "regex").when(F.col("method").endswith("name_pattern"), "name_patterns").otherwise(F.col("method"))).alias("methods_used"),
        F.avg(F.when(valid, F.col("score"))).alias("avg_confidence"),
    )
    none = F.lit(None).cast("array<string>")
    total = F.coalesce("total_entities", F.lit(0)) + F.coalesce("filtered_entities", F.lit(0))
    return docs.select("doc_id").join(sums, "doc_id", "left").select(
        "doc_id", F.coalesce("total_entities", F.lit(0)).cast("long").alias("total_entities"), F.coalesce("filtered_entities", F.lit(0)).cast("long").alias("filtered_entities"),
        F.coalesce("categories_found", F.array(), none).cast("array<string>").alias("categories_found"), F.array_sort(F.array_union(F.coalesce("methods_used", F.array(), none).cast("array<string>"), F.array(*map(F.lit, loaded)).cast("array<string>"))).alias("methods_used"),
        F.coalesce("avg_confidence", F.lit(0.0)).alias("avg_confidence"),
        F.coalesce(F.col("total_entities") / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("validation_rate"),
    )


def summary_of_entities(found: DataFrame) -> DataFrame:
    """The summary of merged findings: doc_id, total_entities, categories_found, methods_used (as merged), confidence_scores (in order), avg_confidence."""
    scores = F.transform(F.sort_array(F.collect_list(F.struct("seq", "score"))), lambda x: x["score"])
    return found.groupBy("doc_id").agg(F.count("*").alias("total_entities"), _set(F.col("entity_group")).alias("categories_found"), _set(F.col("method")).alias("methods_used"), scores.alias("confidence_scores"), F.avg("score").alias("avg_confidence"))


def summary_by_category(judged: DataFrame) -> DataFrame:
    """entity_group, status, n, docs, avg_score over the corpus."""
    return judged.groupBy("entity_group", "status").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"), F.avg("score").alias("avg_score"))


def corpus_rollup(judged: DataFrame, by: str) -> DataFrame:
    """Counts of findings by a column that came along with them (see detect) and category, with subtotals (null is 'all')."""
    counted = judged.groupBy(by, "entity_group").agg(F.count("*").alias("n"))  # a rollup makes three rows of each of its own
    return counted.rollup(by, "entity_group").agg(F.sum("n").alias("n"))


def group_for_display(judged: DataFrame) -> DataFrame:
    """doc_id, status, entity_group, n, and its findings as words with percentages, in order of appearance."""
    shown = F.concat(F.col("word"), F.lit(" ("), F.format_string("%.1f%%", F.col("score") * 100), F.lit(")"))
    items = F.transform(F.sort_array(F.collect_list(F.struct("start", "seq", shown.alias("shown")))), lambda x: x["shown"])
    return judged.groupBy("doc_id", "status", "entity_group").agg(F.count("*").alias("n"), F.array_join(items, "; ").alias("shown"))


def coverage(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Share of the expected categories (doc_id, expected) that were found, and whether it is at least 0.7."""
    have = found.groupBy("doc_id").agg(_set(F.col("entity_group")).alias("have"))
    ratio = F.size(F.array_intersect("expected", F.coalesce("have", F.array().cast("array<string>")))) / F.size("expected")
    return expected.join(have, "doc_id", "left").select("doc_id", ratio.alias("ratio"), (ratio >= 0.7).alias("passed"))


def preview(text: Column, size: int = 80) -> Column:
    """The beginning of a text and three dots."""
    return F.concat(F.substring(text, 1, size), F.lit("..."))


def most_exposed(judged: DataFrame, k: int) -> DataFrame:
    """The k documents with most valid findings; smaller doc_ids first among equals."""
    valid = judged.where("status = 'VALID'").groupBy("doc_id").agg(F.count("*").alias("n"))
    return valid.orderBy(F.desc("n"), "doc_id").limit(k)


def conflicts(found: DataFrame) -> DataFrame:
    """Pairs of overlapping findings of different categories in one document: doc_id, a, b (categories), n.

    Spans are dealt into buckets of 64 characters, so only spans that share a bucket
    meet; a pair counts in the bucket where its overlap begins. Long spans are in
    several buckets.
    """
    spans = found.select("doc_id", "seq", "entity_group", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / 64), F.floor((F.col("end") - 1) / 64))).alias("bucket")).where("end > start")
    a, b = spans.alias("a"), spans.alias("b")
    same = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.bucket") == F.col("b.bucket"))
    meet = (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end")) & (F.col("a.entity_group") < F.col("b.entity_group"))
    once = F.floor(F.greatest("a.start", "b.start") / 64) == F.col("a.bucket")
    return a.join(b, same & meet & once).groupBy(F.col("a.doc_id").alias("doc_id"), F.col("a.entity_group").alias("a"), F.col("b.entity_group").alias("b")).agg(F.count("*").alias("n"))
