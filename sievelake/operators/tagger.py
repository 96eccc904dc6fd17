"""Findings of models: an interface for taggers, and the normalisation of what they return.

No model comes with this library. A tagger is a function that a worker calls once
to get another one, from texts to raw findings; or its findings are a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_TEXTS = ("entity_group", "entity", "word", "score", "start", "end")
RAW = "doc_id long, model string, i int, " + ", ".join(f"{x} string" for x in _TEXTS)


def first_that_loads(*ways: Callable[[], Callable[[str], list[dict]]]) -> Callable[[], Callable[[str], list[dict]]]:
    """A loader that tries ways to load a model in turn; the error of the last one, if none works."""

    def load() -> Callable[[str], list[dict]]:
        for way in ways[:-1]:
            try:
                return way()
            except Exception:  # noqa: BLE001  whatever a way fails with, the next one is tried
                continue
        return ways[-1]()

    return load


def run_tagger(docs: DataFrame, name: str, load: Callable[[], Callable[[str], list[dict]]]) -> DataFrame:
    """Raw findings of docs (doc_id, text). load is called once a task; a text that fails has none; blank ones aren't asked about."""

    def tag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                if not isinstance(text, str) or not text.strip():
                    continue
                try:
                    found = model(text)
                except Exception:  # noqa: BLE001  a failing text must not end the job
                    continue
                for i, x in enumerate(found):
                    rows.append((doc, name, i, *(None if x.get(k) is None else str(x[k]) for k in _TEXTS)))
            yield pd.DataFrame(rows, columns=["doc_id", "model", "i", *_TEXTS])

    return docs.select("doc_id", "text").mapInPandas(tag, RAW)


def join_tokens(tokens: DataFrame, strategy: str = "simple") -> DataFrame:
    """Findings of runs of tokens (doc_id, model, i, label, score, start, end, inside): as raw findings, i numbering those of a document and model.

    Labels are O, or a category, with B- or I- before it or not. Tokens next to each
    other of one category are a finding, unless the later one's label begins with B-. The
    score is the mean. ``simple`` takes each token by itself; ``first`` takes words, which
    are a token and those after it that are ``inside`` it, by their first token's label
    and score. A null label is O.
    """
    if strategy not in ("simple", "first"):
        raise ValueError(f"no strategy {strategy}")
    by = Window.partitionBy("doc_id", "model").orderBy("i")
    some = tokens.withColumn("label", F.coalesce("label", F.lit("O")))
    if strategy == "first":
        some = some.withColumn("word", F.sum(F.when(F.col("inside"), 0).otherwise(1)).over(by))
        some = some.groupBy("doc_id", "model", "word").agg(F.min("i").alias("i"), F.min_by("label", "i").alias("label"), F.min_by("score", "i").alias("score"), F.min("start").alias("start"), F.max("end").alias("end"))
    tagged = some.withColumn("category", F.regexp_replace("label", "^[BI]-", ""))
    before = F.lag("category").over(by)
    new = before.isNull() | (before != F.col("category")) | F.col("label").startswith("B-")
    runs = tagged.withColumn("run", F.sum(new.cast("int")).over(by)).where("category <> 'O'")
    found = runs.groupBy("doc_id", "model", "run").agg(F.first("category").alias("entity_group"), F.avg("score").alias("score"), F.min("start").alias("start"), F.max("end").alias("end"))
    number = F.row_number().over(Window.partitionBy("doc_id", "model").orderBy("run")) - 1
    return found.select("doc_id", "model", number.alias("i"), "entity_group", F.lit(None).cast("string").alias("entity"), *(F.col(x).cast("string").alias(x) for x in ("score", "start", "end")))


def normalise(docs: DataFrame, raw: DataFrame, own_words: bool = False) -> DataFrame:
    """Raw findings (doc_id, model, i, entity_group, entity, score, start, end, all but the first as text) as findings.

    The label is entity_group, or else entity, or else UNKNOWN; empty ones count as
    missing. Missing scores and places are 0; a finding whose score or place isn't a
    number is left out. The word is what the text has at the place, or with ``own_words``
    what the model calls it (word, where it isn't null). Blank texts have none.
    """
    label = F.coalesce(F.nullif("entity_group", F.lit("")), F.nullif("entity", F.lit("")), F.lit("UNKNOWN"))
    number = {"score": "double", "start": "int", "end": "int"}
    cast = {k: F.when(F.col(k).isNull(), F.lit(0).cast(kind)).otherwise(F.col(k).try_cast(kind)) for k, kind in number.items()}
    clean = raw.withColumn("label", label).withColumns(cast).where("score IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL")
    seen = docs.where(F.col("text").rlike(r"(?U)\S")).select("doc_id", "text")
    size = F.length("text")
    low, high = (F.least(F.greatest(F.when(F.col(k) < 0, F.col(k) + size).otherwise(F.col(k)), F.lit(0)), size) for k in ("start", "end"))
    word = F.substr(F.col("text"), low + 1, F.greatest(high - low, F.lit(0)))
    if own_words:
        word = F.coalesce(F.col("word"), word)
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("model", "i")) - 1
    return clean.join(seen, "doc_id").select("doc_id", seq.alias("seq"), F.col("label").alias("entity_group"), word.alias("word"), "start", "end", "score", F.concat(F.lit("ml_"), F.col("model")).alias("method"))
