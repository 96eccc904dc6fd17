"""Detection: texts to findings."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.catalog import Pattern, detectors, labelled, names
from ..functions.columns import NOT_PLAIN, finder, of_catalog
from ..functions.spans import FINDING, empty, findings


@dataclass(frozen=True)
class Options:
    """What to look for and how; fixed when a query is built, so what isn't asked for isn't in its plan."""

    use_regex: bool = True
    use_contextual: bool = True
    use_names: bool = False
    use_ml: bool = True
    min_confidence: float = 0.5
    variant: str = "strict"
    profile: str = "intended"
    categories: tuple[str, ...] | None = None


def patterns(options: Options) -> list[Pattern]:
    """The patterns that the options ask for, in the order in which findings of one place count."""
    only = None if options.categories is None else list(options.categories)
    out: list[Pattern] = []
    if options.use_regex:
        out += detectors(options.variant, options.profile, only)
    if options.use_contextual:
        out += labelled(options.variant, options.profile, only)
    if options.use_names:
        out += names(only)
    return out


def spread(docs: DataFrame, part: int | None = None) -> DataFrame:
    """docs, dealt out evenly if their plan has fewer partitions than there are cores; large inputs are left as they are.

    With part, there is a partition for so many bytes of their files, too.

    Asking for the partitions plans the frame; if it has shuffles of its own, they run.
    """
    if docs.isStreaming:
        return docs
    cores = docs.sparkSession.sparkContext.defaultParallelism
    now = docs._jdf.queryExecution().toRdd().getNumPartitions()
    wanted = 0 if part is None else -(-int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // part)
    return docs.repartition(max(2 * cores, wanted)) if now < max(cores, wanted) else docs


def model_findings(ml: DataFrame) -> DataFrame:
    """The findings of models (normalised, see tagger) as an array by doc_id."""
    one = F.struct("entity_group", "word", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("score").cast("double").alias("score"), "method")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", one.alias("x")))), lambda y: y["x"])
    return ml.groupBy(F.col("doc_id").alias("_id")).agg(ordered.alias("_ml"))


def with_findings(docs: DataFrame, options: Options = Options(), ml: DataFrame | None = None, name: str = "found") -> DataFrame:
    """docs (doc_id, text and any other columns) with an array of each row's own findings (FINDING), by pattern, then place.

    Rows are taken one by one, so doc_ids may be null or repeated. Findings of models
    follow, for every row of their doc_id. Null and empty texts have none.
    """
    own = findings(F.col("text"), patterns(options))
    if ml is None or not options.use_ml:
        return docs.withColumn(name, own)
    joined = docs.join(model_findings(ml), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return joined.withColumn(name, F.concat(own, F.coalesce("_ml", empty(FINDING)))).drop("_id", "_ml")


def exploded(docs: DataFrame, found: Column | str = "found", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row a finding: doc_id, seq (its place in the array), the columns in keep, and the finding's own.

    By the outer form, whose rows without a finding are dropped: of the inner one
    Spark infers that the array isn't empty, and works it out two more times to see.
    """
    rows = docs.select("doc_id", *keep, F.posexplode_outer(found).alias("seq", "_x")).where("seq IS NOT NULL")
    return rows.select("doc_id", *keep, "seq", "_x.*")


def detect(docs: DataFrame, options: Options = Options(), ml: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """All findings in docs (doc_id, text): doc_id, seq, entity_group, word, start, end, score, method.

    seq numbers a row's findings by pattern, then place. Findings of a model
    (normalised, see tagger) come after them. Null and empty texts have none. Columns
    in ``keep`` go along. Nothing is shuffled, unless there are findings of a model.
    """
    return exploded(with_findings(docs, options, ml), keep=keep)


def detect_columns(docs: DataFrame, options: Options = Options(), keep: tuple[str, ...] = ()) -> DataFrame:
    """The findings of detect, without those of models, looked for in whole columns of texts: for many patterns at once.

    Texts that aren't plain (see columns) are looked through as detect does, in the same
    scan. So are all texts if some pattern isn't the catalog's. Nothing is shuffled.
    """
    wanted = patterns(options)
    if not wanted or not of_catalog(wanted):
        return detect(docs, options, keep=keep)
    text, plain, kept = F.col("text"), ~F.rlike("text", F.lit(NOT_PLAIN)), ("doc_id", *keep)
    parted = docs.select(*kept, F.when(plain, text).alias("text"), F.when(~plain, findings(text, wanted)).alias("found"))
    find = finder(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from find(batch)

    kinds = [*(parted.schema[x].dataType for x in kept), IntegerType(), IntegerType(), StringType(), IntegerType(), IntegerType()]
    places = [F.col(f"_{i}") for i in range(len(kinds))]
    which, seq, word, start, end = places[len(kept) :]
    of_pattern = lambda values: F.get(F.array(*map(F.lit, values)), which)
    return parted.mapInArrow(run, StructType([StructField(f"_{i}", kind) for i, kind in enumerate(kinds)])).select(
        *(x.alias(name) for x, name in zip(places, kept)), seq.alias("seq"), of_pattern([p.category for p in wanted]).alias("entity_group"), word.alias("word"),
        start.alias("start"), end.alias("end"), of_pattern([p.score for p in wanted]).alias("score"), of_pattern([p.method for p in wanted]).alias("method"),
    )


def detect_arrow(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """The same findings by Python's regular expressions over Arrow batches: another engine to hold detect against.

    It needs no shuffle, but leaves whole-stage code; digits, blanks and word
    boundaries are those of Unicode.
    """
    wanted = patterns(options)
    schema = "doc_id long, seq int, entity_group string, word string, start int, end int, score double, method string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(p, re.compile(p.regex)) for p in wanted]
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = [(p.category, m[p.group], *m.span(p.group), p.score, p.method) for p, r in compiled for m in r.finditer(text or "")]
                rows += [(doc, i, *x) for i, x in enumerate(found)]
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 8, kinds)], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
