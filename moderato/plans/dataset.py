"""Dataset build (U1, U2, A1, M3): silver rows drawn from each given split;
native, clean-conversational and custom rows split 80/10/10; merged without
dedup in a seeded order.  The silver test draw stays apart from the native test."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moderato.functions.labels import scored_row
from moderato.functions.text import truncate_for_translation
from moderato.operators.sampling import capped_draw, hash_rank, seeded_key, split_assign_by
from moderato.schema import LABELS, SOURCE_CLEAN, SOURCE_SILVER

TRAINING_COLS = ["comment_text_en", "comment_text_sn", *LABELS, "source"]


def clean_rows(df: DataFrame, text="text") -> DataFrame:
    """Clean conversational rows: all six labels 0."""
    return df.withColumns({"comment_text_en": F.lit(""), "comment_text_sn": F.col(text),
                           **{l: F.lit(0) for l in LABELS}, "source": F.lit(SOURCE_CLEAN)})


def identity_translator():
    """Default translator factory for ``translate``: returns its input."""
    def make():
        return lambda texts: list(texts)
    return make


def translate(df: DataFrame, src_col: str, out_col: str, factory=None, batch_size: int = 16) -> DataFrame:
    """U3 for translation: a model built once per task, fed batches of 16."""
    factory = factory or identity_translator()
    from pyspark.sql import types as T
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.StringType())])

    def run(batches):
        model = factory()
        for pdf in batches:
            texts = pdf[src_col].fillna("").tolist()
            out = []
            for i in range(0, len(texts), batch_size):
                out.extend(model(texts[i:i + batch_size]))
            pdf[out_col] = out
            yield pdf
    return df.mapInPandas(run, schema)


#: Rows drawn from each given split, and the split whose unscored rows are left out first.
SILVER_TARGETS = {"train": 3000, "validation": 500, "test": 500}
SCORED_ONLY = ("test",)


def silver_splits(comments: DataFrame, id_col: str, split_col: str, targets: dict[str, int] = SILVER_TARGETS,
                  scored_only=SCORED_ONLY, translator=None) -> DataFrame:
    """M3 for each given split: (test: P1) -> M1 -> P6 -> translate -> training
    rows, with ``pos`` and the split."""
    df = comments.filter(~F.col(split_col).isin(list(scored_only)) | scored_row())
    sample = capped_draw(df, targets, id_col, split_col)
    sample = sample.withColumn("comment_text_en", truncate_for_translation("comment_text"))
    out = translate(sample, "comment_text_en", "comment_text_sn", translator)
    return out.withColumn("source", F.lit(SOURCE_SILVER))


def keyed(df: DataFrame, name: str, id_col: str) -> DataFrame:
    """Training rows of one part, with a ``key`` that is unique over all parts."""
    return df.withColumns({"part": F.lit(name), "key": F.concat(F.lit(f"{name}:"), F.col(id_col).cast("string"))})


def split_parts(parts: list[DataFrame]) -> DataFrame:
    """Keyed parts, each split 80/10/10 in its own seeded order of ids."""
    rows = reduce(DataFrame.unionByName, [p.select("part", "key", *TRAINING_COLS) for p in parts])
    order = rows.withColumn("_id", F.substring_index("key", ":", -1))
    return split_assign_by(order, "_id", ["part"]).drop("_id")


def merge_sources(parts: list[DataFrame]) -> DataFrame:
    """Union of keyed parts that have a split, no dedup; ``pos`` is a row's place in its
    split's seeded order."""
    cols = ["split", "key", *TRAINING_COLS]
    rows = reduce(DataFrame.unionByName, [p.select(*cols) for p in parts])
    return hash_rank(rows, seeded_key("key"), ["key"], by=["split"])
