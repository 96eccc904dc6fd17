"""The engine: detection, validation, merging, summaries and redaction put together."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.catalog import catalog
from ..operators.detect import Options, detect, patterns
from ..operators.merge import merge
from ..operators.redact import redact_texts
from ..operators.summarize import summary_by_document
from ..operators.validate import validate


class Engine:
    """Queries over documents (doc_id, text). ``models`` names the models that are loaded, whose findings are in ``ml``."""

    def __init__(self, spark: SparkSession, options: Options = Options(), ml: DataFrame | None = None, models: tuple[str, ...] = ()) -> None:
        self.spark, self.options, self.ml, self.models = spark, options, ml, models

    def detect(self, docs: DataFrame) -> DataFrame:
        """Raw findings."""
        return detect(docs, self.options, self.ml)

    def detect_merged(self, docs: DataFrame) -> DataFrame:
        """Findings of enough confidence, overlapping ones of a category merged; no validation."""
        return merge(self.detect(docs).where((F.col("score") >= self.options.min_confidence) & ~F.isnan("score")))

    def detect_validated(self, docs: DataFrame, cross: bool = False) -> DataFrame:
        """Findings with verdict and status."""
        return validate(self.detect(docs), self.options.min_confidence, cross)

    def summarize(self, docs: DataFrame, cross: bool = False) -> DataFrame:
        return summary_by_document(docs, self.detect_validated(docs, cross), self.models)

    def anonymize(self, docs: DataFrame, replacement: str = "[REDACTED]", mode: str = "safe", cross: bool = False) -> DataFrame:
        """Texts without their valid findings."""
        return redact_texts(docs, self.options, replacement, mode, cross, ml=self.ml)

    def status(self) -> DataFrame:
        """One row: whether a model's findings are there, how many patterns are in use, Spark's version."""
        return self.spark.createDataFrame([(self.ml is not None, len(patterns(self.options)), self.spark.version)], "model boolean, patterns int, version string")

    def catalog(self) -> DataFrame:
        return catalog(self.spark)

    def register(self, name: str = "detect_pii") -> None:
        """Makes detection a table function of SQL: SELECT d.doc_id, p.* FROM docs d, LATERAL detect_pii(d.text) p."""
        wanted = patterns(self.options)

        class Detect:
            def __init__(self) -> None:
                import re

                self.compiled = [(p, re.compile(p.regex)) for p in wanted]

            def eval(self, text: str | None) -> Iterable[tuple]:
                for p, r in self.compiled:
                    for m in r.finditer(text or ""):
                        yield p.category, m[p.group], *m.span(p.group), p.score, p.method

        self.spark.udtf.register(name, udtf(Detect, returnType="entity_group string, word string, start int, end int, score double, method string"))
