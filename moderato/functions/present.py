"""Presentation helpers of the moderation page, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from moderato.schema import LABELS


def display_name(label: Column) -> Column:
    """First underscore -> space (``severe_toxic`` -> ``severe toxic``)."""
    return F.regexp_replace(label, r"^([^_]*)_", "$1 ")


def percent(score: Column) -> Column:
    """Score as a whole percentage, half rounded up, capped at 100."""
    return F.least(F.lit(100), F.floor(score * 100 + 0.5).cast("int"))


def ranked_scores(scores: dict[str, Column]) -> Column:
    """O1: ``array<struct<label, score, pct>>`` high to low; ties keep the
    LABELS order (a stable sort)."""
    items = [F.struct((-scores[l]).alias("neg"), F.lit(i).alias("i"), F.lit(l).alias("label"),
                      scores[l].alias("score"), percent(scores[l]).alias("pct"))
             for i, l in enumerate(LABELS)]
    return F.transform(F.array_sort(F.array(*items)),
                       lambda x: F.struct(x["label"].alias("label"), x["score"].alias("score"), x["pct"].alias("pct")))


def language_badge(language: Column) -> Column:
    return F.concat(F.lit("["), F.upper(language), F.lit("]"))


def verdict_line(language: Column, is_toxic: Column, flagged: Column) -> Column:
    """``[EN] Flagged: toxic, insult`` or ``[EN] No toxicity detected``."""
    badge = language_badge(language)
    return F.when(is_toxic, F.concat(badge, F.lit(" Flagged: "), F.array_join(flagged, ", "))) \
        .otherwise(F.concat(badge, F.lit(" No toxicity detected")))


def label_tags(flagged: Column) -> Column:
    """Display names of the flagged labels, or ``none``."""
    return F.when(F.size(flagged) > 0, F.array_join(F.transform(flagged, display_name), " ")).otherwise(F.lit("none"))


def batch_verdict(flagged_count: Column, total: Column) -> Column:
    return F.concat(F.lit("Batch Result: "), flagged_count.cast("string"), F.lit(" of "),
                    total.cast("string"), F.lit(" comments flagged"))
