"""Detection on streams: a text's findings depend on that text alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.detect import Options, detect
from ..operators.redact import redact_texts
from ..operators.validate import validate


def live_findings(docs: DataFrame, options: Options = Options(), cross: bool = False) -> DataFrame:
    """The judged findings of a stream of texts (doc_id, text), as a stream without state: any sink, append mode, any trigger."""
    return validate(detect(docs, options), options.min_confidence, cross)


def live_redaction(docs: DataFrame, options: Options = Options(), replacement: str = "[REDACTED]") -> DataFrame:
    """A stream of texts without their valid findings (doc_id, redacted), without state."""
    return redact_texts(docs, options, replacement).select("doc_id", "redacted")


def detect_stream(docs: DataFrame, sink, options: Options = Options(), cross: bool = False, checkpoint: str | None = None) -> StreamingQuery:
    """Hands the judged findings of every micro-batch of a stream (doc_id, text) to sink(frame, batch_id), and stops when all there is has been read.

    Batches are independent, so a batch that is run again gives the same rows; the
    sink should replace what it has of a batch_id.
    """
    writer = live_findings(docs, options, cross).writeStream.foreachBatch(sink).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def windowed_counts(docs: DataFrame, regex: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Texts (ts, text) that match, by window of event time; rows later than ``late`` are left out."""
    return docs.withWatermark("ts", late).groupBy(F.window("ts", window)).agg(F.count_if(F.col("text").rlike(regex)).alias("n"))
