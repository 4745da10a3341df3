"""Request validation (P5): a reason column, then a valid / rejected split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moderato.schema import MAX_BATCH_SIZE, MAX_TEXT_LENGTH, REQUEST_LANGUAGES


def reject_reason_single(text, language):
    """Single request: text 1..5000 code points (whitespace-only is valid),
    language in en/sn/auto.  NULL when valid."""
    n = F.length(text)
    return (F.when(text.isNull(), F.lit("missing_text"))
            .when(n < 1, F.lit("empty_text"))
            .when(n > MAX_TEXT_LENGTH, F.lit("text_too_long"))
            .when(~F.coalesce(language.isin(REQUEST_LANGUAGES), F.lit(False)), F.lit("bad_language")))


def validate_single(df: DataFrame, text_col="text", language_col="language") -> DataFrame:
    return df.withColumn("reason", reject_reason_single(F.col(text_col), F.col(language_col))) \
             .withColumn("valid", F.col("reason").isNull())


def validate_batches(df: DataFrame, batch_col: str, language_col: str | None = None,
                     language: str = "en") -> DataFrame:
    """Batch requests: 1..100 texts per batch (texts inside a batch have no
    length rule).  One row per batch; a partial count per task first, so a
    hot batch costs one row per task before the shuffle."""
    lang = F.first(F.col(language_col)) if language_col else F.lit(language)
    agg = df.groupBy(batch_col).agg(F.count(F.lit(1)).alias("n_items"), lang.alias("language"))
    reason = (F.when(F.col("n_items") < 1, F.lit("empty_batch"))
              .when(F.col("n_items") > MAX_BATCH_SIZE, F.lit("batch_too_large"))
              .when(~F.coalesce(F.col("language").isin(REQUEST_LANGUAGES), F.lit(False)), F.lit("bad_language")))
    return agg.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())
