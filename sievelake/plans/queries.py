"""Named queries over the tables of a data folder, one for each operator."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.catalog import catalog, described, detectors, names
from ..functions.spans import findings
from ..operators import evaluate as ev
from ..operators import summarize as sm
from ..operators.detect import Options, detect, detect_arrow, detect_columns, exploded, spread
from ..operators.merge import merge
from ..operators.redact import redact, redact_texts
from ..operators.tagger import join_tokens, normalise
from ..operators.validate import drop_invalid, validate
from ..sources.reports import parse_descriptions, parse_reports, report_classes, to_result_json
from .engine import Engine
from .notes import CASES, CLASSES, COVERAGE, PROSE, TAGGED, TOKENS, notes, short

#: What is looked for in the documents: all categories but those that words and short numbers of any prose are of.
IN_DOCUMENTS = ("TELEPHONENUM", "EMAIL", "ZIPCODE", "DATE", "TIME", "AADHAAR", "PAN", "VOTERID", "DRIVERLICENSENUM", "ACCOUNTNUM", "IFSC", "CREDITCARDNUM", "TRANSACTIONID", "PASSPORTNUM")
#: What is redacted in conversations.
IN_TURNS = ("EMAIL", "ACCOUNTNUM")
#: Forms of categories that no detector knows.
OWN_FORMS = {"RANK": "^[0-9]-[A-Z]+$", "NUMBER": "^[0-9]+$", "BROKEN": None}
#: What is redacted and merged in the notes.
IN_NOTES = ("FULLNAME", "EMAIL", "TELEPHONENUM", "ACCOUNTNUM", "IFSC", "AADHAAR", "PAN", "DATE")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spread(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return turns.select((F.col("conv_id") * 100_000 + F.col("turn")).alias("doc_id"), "text")


def _coverage(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COVERAGE, "doc_id long, text string, expected string")


def _cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *x) for i, x in enumerate(CASES)], "doc_id long, entity_group string, word string, score double")


def _digest(found: DataFrame, *by: str) -> DataFrame:
    """Counts and sums that tell one set of findings from another."""
    return found.groupBy(*by).agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"), F.count_distinct("word").alias("words"), F.round(F.sum("score"), 4).alias("scores"))


def _in_documents(spark: SparkSession, sf_dir: str, *categories: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return detect(_documents(spark, sf_dir), Options(use_contextual=False, categories=categories or IN_DOCUMENTS), keep=keep)


def _in_notes(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return detect(notes(spark, sf_dir), Options(**({"categories": IN_NOTES} | options)))


def _all_in_notes(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """Findings of all categories: more than a hundred a note, so a task has few notes, and its words fit into memory."""
    return detect_columns(notes(spark, sf_dir, 1 << 20), Options(**options), keep)


def catalog_overview(spark, sf_dir):
    return catalog(spark).select("ord", "category", "regex", F.size("examples").cast("long").alias("n_examples"), F.array_join("examples", ", ").alias("examples"))


def detect_email(spark, sf_dir):
    return _in_documents(spark, sf_dir, "EMAIL").select("doc_id", "word", "start", "end", "score", "method")


def detect_account(spark, sf_dir):
    return _in_documents(spark, sf_dir, "ACCOUNTNUM").select("doc_id", "word", "start", "end")


def detect_fullname(spark, sf_dir):
    found = _documents(spark, sf_dir).withColumn("found", findings(F.col("text"), names()))
    return _digest(exploded(found), "method")


def detect_all_regex(spark, sf_dir):
    return _digest(_in_notes(spark, sf_dir, use_contextual=False, categories=None), "entity_group", "method")


def detect_library_regex(spark, sf_dir):
    return _digest(_in_notes(spark, sf_dir, use_contextual=False, categories=None, variant="library"), "entity_group", "method")


def detect_contextual(spark, sf_dir):
    return _in_notes(spark, sf_dir, use_regex=False, categories=None).select("doc_id", "entity_group", "word", "start", "end")


def detect_names(spark, sf_dir):
    return _in_notes(spark, sf_dir, use_regex=False, use_contextual=False, use_names=True).select("doc_id", "word", "start", "end", "score", "method")


def detect_as_written(spark, sf_dir):
    return detect(_coverage(spark), Options(profile="as_written")).select("doc_id", "seq", "entity_group", "word", "start", "end", "method")


def union_methods(spark, sf_dir):
    return _digest(_all_in_notes(spark, sf_dir, variant="service", use_names=True), "method")


def _judged(found: DataFrame) -> DataFrame:
    v = F.col("validation")
    return found.select("doc_id", "entity_group", "word", "score", v["valid"].alias("valid"), v["reason"].alias("reason"), v["corrected_category"].alias("corrected_category"), "status", "filter_reason", "original_category")


def validate_strict(spark, sf_dir):
    return _judged(validate(_cases(spark)))


def validate_cross(spark, sf_dir):
    return _judged(validate(_cases(spark), cross=True))


def relabel(spark, sf_dir):
    changed = validate(_cases(spark), cross=True).where("original_category IS NOT NULL AND original_category <> entity_group")
    return changed.groupBy("original_category", "entity_group").agg(F.count("*").alias("n"))


def filter_confidence(spark, sf_dir):
    return validate(_in_notes(spark, sf_dir), 0.92).groupBy("entity_group", "status", "filter_reason").agg(F.count("*").alias("n"))


def merge_islands(spark, sf_dir):
    return merge(_in_notes(spark, sf_dir, variant="service", use_names=True)).select("doc_id", "seq", "entity_group", "word", "start", "end", "score", "method")


def summary_by_doc(spark, sf_dir):
    docs = notes(spark, sf_dir)
    s = sm.summary_by_document(docs, validate(detect(docs, Options(categories=IN_NOTES))))
    return s.select("doc_id", "total_entities", "filtered_entities", F.array_join("categories_found", ",").alias("categories_found"), F.array_join("methods_used", ",").alias("methods_used"), F.round("avg_confidence", 6).alias("avg_confidence"), F.round("validation_rate", 6).alias("validation_rate"))


def summary_of_entities(spark, sf_dir):
    s = sm.summary_of_entities(merge(detect(_coverage(spark), Options(variant="library", use_contextual=False))))
    return s.select("doc_id", "total_entities", F.array_join("categories_found", ",").alias("categories_found"), F.array_join("methods_used", ",").alias("methods_used"), F.round("avg_confidence", 6).alias("avg_confidence"), F.array_join(F.transform("confidence_scores", lambda x: F.format_string("%.2f", x)), ",").alias("scores"))


def summary_by_category(spark, sf_dir):
    return sm.summary_by_category(validate(_in_documents(spark, sf_dir))).withColumn("avg_score", F.round("avg_score", 6))


def corpus_rollup(spark, sf_dir):
    return sm.corpus_rollup(validate(_in_documents(spark, sf_dir, keep=("lang",))), "lang")


def rollup_all_categories(spark, sf_dir):
    return sm.corpus_rollup(validate(_all_in_notes(spark, sf_dir, ("priority",))), "priority")


def group_display(spark, sf_dir):
    return sm.group_for_display(validate(_in_notes(spark, sf_dir)))


def redact_exact(spark, sf_dir):
    docs = _coverage(spark)
    return redact(docs, detect(docs, Options(profile="as_written", use_contextual=False)), mode="exact").select("doc_id", "redacted")


def redact_safe(spark, sf_dir):
    return redact_texts(notes(spark, sf_dir), Options(categories=IN_NOTES)).select("doc_id", "redacted")


def redact_exact_notes(spark, sf_dir):
    """Given names and surnames are found at the same places, so what exact redaction garbles shows."""
    options = Options(profile="as_written", use_contextual=False, categories=("GIVENNAME", "SURNAME"))
    return redact_texts(notes(spark, sf_dir), options, mode="exact", check=False).select("doc_id", "redacted")


def redact_conversations(spark, sf_dir):
    return redact_texts(_turns(spark, sf_dir), Options(use_contextual=False, categories=IN_TURNS), check=False).select("doc_id", "redacted")


def redact_documents(spark, sf_dir):
    return redact_texts(_documents(spark, sf_dir), Options(use_contextual=False, categories=IN_DOCUMENTS)).select("doc_id", "redacted")


def redact_by_model(spark, sf_dir):
    docs = _coverage(spark)
    return redact(docs, normalise(docs, _tagged(spark)), mode="exact").select("doc_id", "redacted")


def clean_docs(spark, sf_dir):
    return _documents(spark, sf_dir).join(_in_documents(spark, sf_dir), "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("n"))


def docs_with_category(spark, sf_dir):
    return _documents(spark, sf_dir).join(_in_documents(spark, sf_dir, "EMAIL"), "doc_id", "left_semi").select("doc_id", "lang", "source")


def topk_exposed_docs(spark, sf_dir):
    return sm.most_exposed(validate(_in_documents(spark, sf_dir)), 20)


def preview(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", sm.preview(F.col("text")).alias("preview"))


def _tagged(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TAGGED, "doc_id long, model string, i int, entity_group string, entity string, score string, start string, end string")


def ml_normalize(spark, sf_dir):
    return normalise(_coverage(spark), _tagged(spark))


def _tokens_joined(spark: SparkSession, strategy: str) -> DataFrame:
    tokens = spark.createDataFrame(TOKENS, "doc_id long, model string, i int, label string, score double, start int, end int, inside boolean")
    return join_tokens(tokens, strategy).select("doc_id", "model", "i", "entity_group", F.round(F.col("score").cast("double"), 6).alias("score"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))


def ml_join_simple(spark, sf_dir):
    return _tokens_joined(spark, "simple")


def ml_join_first(spark, sf_dir):
    return _tokens_joined(spark, "first")


def coverage_ratio(spark, sf_dir):
    texts = _coverage(spark)
    expected = texts.select("doc_id", F.split("expected", ",").alias("expected"))
    return sm.coverage(expected, detect(texts, Options())).withColumn("ratio", F.round("ratio", 6))


def metrics_averages(spark, sf_dir):
    classes = spark.createDataFrame(CLASSES, "entity_group string, precision double, recall double, f1 double, support long")
    return ev.averages(classes).select("average", *(F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")), "support")


def evaluate_gold_vs_pred(spark, sf_dir):
    """Gold are the parts between labels and commas; a detector for each has to find just these."""
    docs = notes(spark, sf_dir)
    gold = None
    for label, category in (("Email: ", "EMAIL"), ("Account: ", "ACCOUNTNUM"), ("Gender: ", "GENDER"), ("City: ", "CITY")):
        start = F.locate(label, F.col("text")) - 1 + len(label)
        rest = F.substring_index(F.substr(F.col("text"), start + 1), ",", 1)
        one = docs.select("doc_id", start.alias("start"), (start + F.length(rest)).alias("end"), F.lit(category).alias("entity_group"))
        gold = one if gold is None else gold.unionByName(one)
    found = detect(docs, Options(use_contextual=False, categories=("EMAIL", "ACCOUNTNUM", "GENDER", "CITY")))
    return ev.evaluate(gold, found).select("entity_group", *(F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")), "tp", "predicted", "support")


def report_rows(spark, sf_dir):
    """Class rows of a report in JSON."""
    scores = ("precision", "recall", "f1-score", "support")
    text = json.dumps({"precision": 0.5, "recall": 0.5, "f1": 0.5, "per_class": {c: dict(zip(scores, x)) for c, *x in [*CLASSES, ("micro avg", 0.5, 0.5, 0.5, 1)]}})
    return report_classes(parse_reports(spark.createDataFrame([("a", text), ("b", "{broken")], "file string, value string"))).select("entity_group", "precision", "recall", "f1", "support")


def catalog_described(spark, sf_dir):
    prose = parse_descriptions(spark.createDataFrame([(PROSE,)], "value string"))
    return described(catalog(spark), prose).select("ord", "category", "description")


def status(spark, sf_dir):
    return Engine(spark).status().select("model", "patterns")


def blank_texts(spark, sf_dir):
    """Blank and null texts have a summary of zeros."""
    rows = Engine(spark).summarize(short(spark, sf_dir)).withColumn("avg_confidence", F.round("avg_confidence", 6))
    return rows.groupBy("total_entities", "filtered_entities", "avg_confidence", "validation_rate").agg(F.count("*").alias("n"))


def merge_confident(spark, sf_dir):
    found = Engine(spark, Options(min_confidence=0.92, variant="service", use_names=True, categories=IN_NOTES)).detect_merged(notes(spark, sf_dir))
    return _digest(found, "entity_group", "method")


def validate_batch(spark, sf_dir):
    return _digest(drop_invalid(_all_in_notes(spark, sf_dir, variant="service")), "entity_group")


def validate_cross_notes(spark, sf_dir):
    """A verdict rests on category, word and score, so findings that are alike in these are judged once."""
    alike = _all_in_notes(spark, sf_dir, variant="service").groupBy("entity_group", "word", "score").agg(F.count("*").alias("times"))
    judged = validate(alike, cross=True)
    return judged.groupBy("original_category", "entity_group", "status").agg(F.sum("times").alias("n"), F.count_distinct("word").alias("words"))


def detect_unknown_categories(spark, sf_dir):
    """Categories without a detector are found by their form, which is anchored."""
    docs = short(spark, sf_dir).select("doc_id", F.col("priority").alias("text"))
    return _digest(exploded(docs.withColumn("found", findings(F.col("text"), detectors(forms=OWN_FORMS)))), "entity_group")


def detect_by_sql(spark, sf_dir):
    Engine(spark, Options(use_contextual=False, categories=IN_TURNS)).register("detect_pii")
    return spark.sql("SELECT d.doc_id, p.entity_group, p.word, p.start, p.end FROM {docs} d, LATERAL detect_pii(d.text) p", docs=notes(spark, sf_dir))


def detect_by_python(spark, sf_dir):
    return _digest(detect_arrow(notes(spark, sf_dir), Options(use_contextual=False)), "entity_group", "method")


def json_results(spark, sf_dir):
    """Results as JSON, read back."""
    rows = summary_by_category(spark, sf_dir)
    return to_result_json(rows).select(F.from_json("value", rows.schema).alias("x")).select("x.*")


def span_conflicts(spark, sf_dir):
    found = _in_notes(spark, sf_dir, use_contextual=False, categories=("ACCOUNTNUM", "TELEPHONENUM", "AADHAAR", "STREET", "BUILDINGNUM"))
    return sm.conflicts(found).groupBy("a", "b").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        catalog_overview, detect_email, detect_account, detect_fullname, detect_all_regex, detect_library_regex, detect_contextual, detect_names, detect_as_written, union_methods,
        validate_strict, validate_cross, relabel, filter_confidence, merge_islands, summary_by_doc, summary_of_entities, summary_by_category, corpus_rollup, group_display,
        redact_exact, redact_safe, redact_conversations, clean_docs, docs_with_category, topk_exposed_docs, preview, ml_normalize, coverage_ratio, metrics_averages,
        evaluate_gold_vs_pred, span_conflicts, rollup_all_categories, redact_exact_notes, redact_documents, redact_by_model, ml_join_simple, ml_join_first, report_rows, catalog_described, status, blank_texts,
        merge_confident, validate_batch, validate_cross_notes, detect_unknown_categories, detect_by_sql, detect_by_python, json_results,
    ]
    return {f.__name__: f for f in own}
