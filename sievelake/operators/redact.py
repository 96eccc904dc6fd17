"""Redaction of findings.

``safe`` replaces each stretch of overlapping spans once. ``exact`` replaces span after
span, last start first, in the text as already changed, which garbles overlapping ones.
Both agree where spans are apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import empty, in_slices, let
from .detect import Options, with_findings
from .validate import valid

_SPAN = "struct<start: int, end: int>"


def _splice(text: Column, spans: Column, replacement: Column) -> Column:
    """Puts the replacement in the place of each span in turn, in the text as it then is."""
    return F.aggregate(spans, text, lambda acc, x: F.concat(F.substring(acc, 1, x["start"]), replacement, F.substr(acc, x["end"] + 1)))


def _without(text: Column, spans: Column, replacement: str) -> Column:
    """The text with the replacement in the place of each stretch of overlapping spans; these are sorted.

    What stays is cut out of the text in slices, so that no cut seeks through all of it.
    """

    def kept(some: Column, reach: Column, upto: Column) -> Column:
        part = F.substring(text, reach + 1, F.greatest(upto - reach, F.lit(0)))

        def step(acc: Column, x: Column) -> Column:
            piece = F.substring(acc["part"], acc["reach"] - reach + 1, x["start"] - acc["reach"])
            out = F.when(x["start"] >= acc["reach"], F.concat(acc["out"], F.array(piece))).otherwise(acc["out"])
            return F.struct(acc["part"].alias("part"), F.greatest(acc["reach"], x["end"]).alias("reach"), out.alias("out"))

        return F.aggregate(some, F.struct(part.alias("part"), reach.alias("reach"), empty("string").alias("out")), step, lambda acc: acc["out"])

    reach = lambda some: F.coalesce(F.array_max(F.transform(some, lambda x: x["end"])), F.lit(0))
    pieces = in_slices(spans, reach, kept, F.lit(0), F.greatest)
    return F.array_join(F.concat(pieces, F.array(F.substr(text, reach(spans) + 1))), replacement)


def redacted(text: Column, found: Column, replacement: str = "[REDACTED]", mode: str = "safe") -> Column:
    """The text without the spans of an array of findings (start, end; in the order in which equal starts are replaced); null if the text is."""
    if mode not in ("safe", "exact"):
        raise ValueError(f"no mode {mode}")
    span = lambda x: (x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"))
    if mode == "safe":
        ordered = F.array_sort(F.array_distinct(F.transform(found, lambda x: F.struct(*span(x)))))
        new = let(ordered, lambda s: _without(text, s, replacement))
    else:
        ordered = F.array_sort(F.transform(found, lambda x, i: F.struct((-x["start"]).cast("int").alias("down"), i.alias("i"), *span(x))))
        new = _splice(text, ordered, F.lit(replacement))
    return F.when(F.coalesce(F.size(found), F.lit(0)) <= 0, text).otherwise(new)


def redact(docs: DataFrame, found: DataFrame, replacement: str = "[REDACTED]", mode: str = "safe") -> DataFrame:
    """doc_id, text and redacted of docs (doc_id, text), without the spans of found (doc_id, seq, start, end), a table.

    A finding holds for every row of its doc_id, a null one for rows without any.
    Documents without findings keep their text. See redact_texts for what is found
    in the texts themselves, which needs no join and no doc_id.
    """
    spans = F.array_sort(F.collect_list(F.struct("seq", "start", "end")))
    lists = found.groupBy(F.col("doc_id").alias("_id")).agg(spans.alias("_spans"))
    joined = docs.select("doc_id", "text").join(lists, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return joined.select("doc_id", "text", redacted(F.col("text"), F.col("_spans"), replacement, mode).alias("redacted"))


def redact_texts(docs: DataFrame, options: Options = Options(), replacement: str = "[REDACTED]", mode: str = "safe", cross: bool = False, check: bool = True, ml: DataFrame | None = None) -> DataFrame:
    """doc_id, text and redacted of every row of docs (doc_id, text), without what is found in it.

    With ``check`` only valid findings of enough confidence go (see validate). Each
    row is redacted by its own findings, so doc_ids may be null or repeated; nothing is
    shuffled, unless there are findings of a model.
    """
    found = with_findings(docs.select("doc_id", "text"), options, ml, "_found")
    if check:
        found = found.withColumn("_found", F.filter("_found", lambda x: valid(x["entity_group"], x["word"], x["score"], options.min_confidence, cross)))
    return found.select("doc_id", "text", redacted(F.col("text"), F.col("_found"), replacement, mode).alias("redacted"))
