"""Validation: is a finding's word of the form of its category?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import FORMS, PRIORITY


def _has_form(word: Column, form: str) -> Column:
    """Whether the word has the form from its start on; digits, blanks and letters are those of Unicode, only \\n ends a line."""
    return word.rlike(f"(?dU)^(?:{form})") if form != ".*" else word.isNotNull()


def _own(category: Column, word: Column, forms: dict[str, str | None]) -> Column:
    """Whether the word has the form of its category; null if there is no form."""
    out = F.when(F.lit(False), F.lit(False))
    for c, form in forms.items():
        if form is not None:
            out = out.when(category == c, _has_form(word, form))
    return out


def _other(word: Column, forms: dict[str, str | None]) -> Column:
    """The first other category whose form the word has: in order of PRIORITY, then of the forms, without STREET and whatever else accepts everything."""
    order = [c for c in PRIORITY if forms.get(c)] + [c for c, form in forms.items() if c != "STREET" and form and form != ".*" and c not in PRIORITY]
    return F.coalesce(*(F.when(_has_form(word, forms[c]), F.lit(c)) for c in order), F.lit(None).cast("string"))


def valid(category: Column, word: Column, score: Column, min_confidence: float = 0.5, cross: bool = False, forms: dict[str, str | None] = FORMS) -> Column:
    """Whether a finding is valid and its score at least min_confidence, as in validate(), but for a finding in an array, too."""
    own = F.coalesce(_own(category, word, forms), F.lit(False))
    if cross:
        known = F.coalesce(category.isin(*(c for c, form in forms.items() if form is not None)), F.lit(False))
        own = own | known & _other(word, forms).isNotNull()
    return own & F.coalesce((score >= min_confidence) & ~F.isnan(score), F.lit(False))


def drop_invalid(found: DataFrame, cross: bool = False, forms: dict[str, str | None] = FORMS) -> DataFrame:
    """The findings whose word is of the form of their category (or of another, if words are cross-checked), whatever their score."""
    return validate(found, float("-inf"), cross, forms).where("validation.valid").drop("status", "filter_reason")


def validate(found: DataFrame, min_confidence: float = 0.5, cross: bool = False, forms: dict[str, str | None] = FORMS) -> DataFrame:
    """Adds validation, status (VALID or FILTERED), filter_reason and original_category to findings.

    The validation is a verdict: valid, reason, confidence, and, if words are
    cross-checked, corrected_category and original_category. Then a word that hasn't
    the form of its category but that of another is valid as that other.

    VALID takes a valid word and a score of at least min_confidence (NaN is less);
    only then does a correction change the category. A valid word with a low score
    is filtered with the reason that it is valid.
    """
    category, word, score, own, other = (F.col(x) for x in ("entity_group", "word", "score", "_own", "_other"))
    tried = found.withColumn("_own", _own(category, word, forms)).withColumn("_other", F.when(~own, _other(word, forms)) if cross else F.lit(None).cast("string"))
    form = F.element_at(F.create_map(*(F.lit(x) for c, form in forms.items() if form is not None for x in (c, form))), category)
    good, bad = ("Matches %s schema pattern", "Does not match %s schema pattern: %s") if cross else ("Matches schema pattern", "Does not match schema pattern: %2$s")
    reason = (
        F.when(~category.isin(*forms), F.concat(F.lit("Unknown category: "), category))
        .when(own.isNull(), F.concat(F.lit("No validation pattern available for "), category))
        .when(own, F.format_string(good, category) if cross else F.lit(good))
        .when(other.isNotNull(), F.format_string("Cross-validated: matches %s pattern instead of %s", other, category))
        .otherwise(F.format_string(bad, category, form))
    )
    verdict = F.struct(
        F.coalesce(own | other.isNotNull(), F.lit(False)).alias("valid"), reason.alias("reason"), score.cast("double").alias("confidence"),
        (F.when(own, category).otherwise(other) if cross else other).alias("corrected_category"), F.when(other.isNotNull(), category).alias("original_category"),
    )
    judged = tried.withColumn("validation", verdict).drop("_own", "_other")
    keep = F.coalesce(F.col("validation.valid") & (score >= min_confidence) & ~F.isnan(score), F.lit(False))
    fixed = F.col("validation.corrected_category")
    return judged.withColumns({
        "status": F.when(keep, "VALID").otherwise("FILTERED"),
        "filter_reason": F.when(~keep, F.col("validation.reason")),
        "original_category": F.when(keep & fixed.isNotNull(), category),
        "entity_group": F.when(keep, F.coalesce(fixed, category)).otherwise(category),
    })
