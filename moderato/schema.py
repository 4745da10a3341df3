"""Labels, default settings and the Spark schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for identical results).
# The six labels, always in this order.
LABELS = ["toxic", "severe_toxic", "obscene", "threat", "insult", "identity_hate"]

# Served per-label thresholds when no setting or request overrides them.
DEFAULT_THRESHOLDS = {
    "threat": 0.35,
    "severe_toxic": 0.35,
    "identity_hate": 0.40,
    "toxic": 0.50,
    "insult": 0.50,
    "obscene": 0.60,
}
# Uniform threshold used by evaluations and by threshold normalisation.
DEFAULT_THRESHOLD = 0.5

# Request limits.
MAX_TEXT_LENGTH = 5000
MAX_BATCH_SIZE = 100
REQUEST_LANGUAGES = ["en", "sn", "auto"]

# Dataset annotation vocabulary.
VALID_LABEL_VALUES = ["toxic", "non-toxic"]
REQUIRED_COLUMNS = ["text", "label", "category", "severity", "source_lemma"]
INGEST_COLUMNS = ["text", "label", "category", "severity"]
# Files in the native directory that are never treated as custom datasets.
RESERVED_NATIVE_FILES = [
    "clean_conversational.csv", "full.csv", "train.csv", "test.csv", "validation.csv",
]
TEMPLATE_FILE = "custom_shona_template.csv"
TEMPLATE_MAX_ROWS = 15

# Random seed of every seeded ordering.
SEED = 42
# End of fixed values.
# ---------------------------------------------------------------------------

# Sources of training rows.
SOURCE_SILVER = "mt_silver"
SOURCE_NATIVE = "native_lexicon"
SOURCE_CLEAN = "native_conversational_clean"
CUSTOM_PREFIX = "custom_"

# Native annotated row, read with every column as a string so that the
# validator, not the reader, decides what is malformed.
NATIVE_ROW = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("source_lemma", T.StringType()),
    T.StructField("surface_variant", T.StringType()),
    T.StructField("has_literal_sense", T.StringType()),
    T.StructField("context_dependent", T.StringType()),
    T.StructField("synthetic", T.StringType()),
])

# Comment table with six int labels (-1 = excluded from scoring).
COMMENT_ROW = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("comment_text", T.StringType())]
    + [T.StructField(l, T.IntegerType()) for l in LABELS]
)

# D3: training row.
TRAINING_ROW = T.StructType(
    [T.StructField("comment_text_en", T.StringType()),
     T.StructField("comment_text_sn", T.StringType())]
    + [T.StructField(l, T.IntegerType()) for l in LABELS]
    + [T.StructField("source", T.StringType())]
)

# Golden example.
GOLDEN_ROW = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("expected", T.ArrayType(T.StringType())),
    T.StructField("known_limitation", T.BooleanType()),
    T.StructField("limitation_note", T.StringType()),
])

# Long metrics table.
METRICS_ROW = T.StructType([
    T.StructField("slice", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("metric", T.StringType()),
    T.StructField("value", T.DoubleType()),
])
