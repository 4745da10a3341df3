"""Dataset validation.

All checks over the data run in **one** scan and one aggregate: each row
names the rules it breaks (null counts, invalid label/category, severity
type and range, consistency), its offending values and its text's digest, and these are counted by
(rule, value) with partial aggregation.  The results are long rows
``(rule, level, n, value)``.  No check collects an
unbounded group: offending values are reported one row per distinct value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moderato.functions.lexicon import VALID_CATEGORIES
from moderato.schema import REQUIRED_COLUMNS, VALID_LABEL_VALUES

DUPLICATE_SAMPLE_CHARS = 40
# Plain decimal numbers: no type suffixes such as "2f".
NUMERIC = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_DUPLICATE = "duplicate_text"
_NULL_TEXT = "\u0000<null>"
_OUT = "rule string, level string, n bigint, value string"


def severity_number(sev: Column) -> Column:
    """Severity as a finite DOUBLE, NULL when missing or not numeric."""
    text = sev.cast("string")
    num = F.when(text.rlike(NUMERIC), text.try_cast("double"))
    return F.when(F.isnan(num) | (F.abs(num) == float("inf")), F.lit(None).cast("double")).otherwise(num)


def missing_columns(df: DataFrame, required=REQUIRED_COLUMNS) -> list[str]:
    return [c for c in required if c not in df.columns]


def validate_rows(df: DataFrame, text="text", label="label", category="category",
                  severity="severity", required=REQUIRED_COLUMNS, order_col: str | None = None) -> DataFrame:
    """Long check rows ``(rule, level, n, value)``; only failing checks plus
    a ``rows`` line.  ``order_col`` gives file order for the duplicate sample."""
    spark = df.sparkSession
    missing = missing_columns(df, required)
    if missing:
        return spark.createDataFrame([("missing_columns", "error", len(missing), ",".join(missing))], _OUT)

    lab, cat = F.col(label), F.col(category)
    sev = severity_number(F.col(severity))
    bad_label = ~F.coalesce(lab.isin(VALID_LABEL_VALUES), F.lit(False))
    bad_cat = ~F.coalesce(cat.isin(VALID_CATEGORIES), F.lit(False))
    none = F.lit(None).cast("string")
    # Each row tells what it is found guilty of, as (rule, value), and its text's digest.
    tells = [(F.lit(True), "rows", none)]
    tells += [(F.col(c).isNull(), f"null:{c}", none) for c in required]
    tells += [(bad_label, "invalid_label", lab.cast("string")), (bad_cat, "invalid_category", cat.cast("string")),
              (sev.isNull(), "severity_non_integer", none), ((sev <= -1) | (sev >= 5), "severity_out_of_range", none),
              ((lab == "non-toxic") & (sev > 0), "nontoxic_with_severity", none), ((lab == "toxic") & (sev == 0), "toxic_severity_zero", none),
              (F.lit(True), _DUPLICATE, F.sha2(F.coalesce(F.col(text).cast("string"), F.lit(_NULL_TEXT)), 256))]
    order = F.col(order_col) if order_col else F.monotonically_increasing_id()
    told = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(r).alias("rule"), v.alias("key"))) for c, r, v in tells]),
                    lambda x: x.isNotNull())
    rows = df.select(F.substring(F.col(text).cast("string"), 1, DUPLICATE_SAMPLE_CHARS).alias("_t"), order.alias("_o"), F.explode(told).alias("_x"))
    # One scan and one shuffle of partial counts; both branches below read that shuffle.
    groups = rows.groupBy("_x.rule", "_x.key").agg(F.count(F.lit(1)).alias("n"), F.min("_o").alias("_o"), F.first("_t", ignorenulls=True).alias("_t"))
    repeated = (F.col("rule") == _DUPLICATE) & (F.col("n") > 1)
    rules = groups.filter((F.col("rule") != _DUPLICATE) | repeated).groupBy("rule").agg(
        F.sum("n").alias("n"), F.min_by("_t", F.when(F.col("_t").isNotNull(), F.col("_o"))).alias("_t"))
    # A single row per rule: the range check only runs when every severity is numeric (as astype(int) would).
    rules = rules.withColumn("_nonint", F.max(F.col("rule") == "severity_non_integer").over(Window.partitionBy(F.lit(1))))
    rules = rules.filter((F.col("rule") != "severity_out_of_range") | ~F.col("_nonint"))
    level = (F.when(F.col("rule") == "rows", F.lit("info"))
             .when(F.col("rule").isin(_DUPLICATE, "nontoxic_with_severity", "toxic_severity_zero"), F.lit("warning")).otherwise(F.lit("error")))
    rules = rules.select("rule", level.alias("level"), "n", F.when(F.col("rule") == _DUPLICATE, F.col("_t")).alias("value"))
    # An empty table still has its line of rows.
    empty = spark.createDataFrame([("rows", "info", 0, None)], _OUT)
    rules = rules.unionByName(empty).groupBy("rule", "level").agg(F.sum("n").alias("n"), F.max("value").alias("value"))
    # Offending values, one row per distinct value.
    values = groups.filter(F.col("rule").isin("invalid_label", "invalid_category")).select(
        F.concat("rule", F.lit("_value")).alias("rule"), F.lit("error").alias("level"), "n", F.col("key").alias("value"))
    return rules.unionByName(values)


def duplicate_text(df: DataFrame, text="text", order_col: str | None = None) -> DataFrame:
    """Rows whose exact text occurs more than once (all copies counted)
    and the first such text that isn't NULL in file order, cut to 40 characters.

    Grouped on sha2(text) so the shuffle key is 32 bytes however long the
    text; a hot text (a third of all rows) is one partial row per task."""
    order = F.col(order_col) if order_col else F.monotonically_increasing_id()
    # Only the first 40 characters are ever reported, so only they travel
    # through the shuffle (not the whole text of every distinct comment).
    keyed = df.select(F.sha2(F.coalesce(F.col(text), F.lit(_NULL_TEXT)), 256).alias("_h"),
                      F.substring(F.col(text), 1, DUPLICATE_SAMPLE_CHARS).alias("_t"), order.alias("_o"))
    groups = keyed.groupBy("_h").agg(F.count(F.lit(1)).alias("c"), F.first("_t", ignorenulls=True).alias("_t"),
                                     F.min("_o").alias("_o")).filter(F.col("c") > 1)
    out = groups.agg(F.sum("c").cast("bigint").alias("n"), F.min_by("_t", F.when(F.col("_t").isNotNull(), F.col("_o"))).alias("_t"))
    return out.filter(F.col("n") > 0).select(
        F.lit("duplicate_text").alias("rule"), F.lit("warning").alias("level"), "n", F.col("_t").alias("value"))


def validate_verdict(checks: DataFrame) -> DataFrame:
    """Fail on missing columns, an empty table or any error; warnings pass."""
    is_err = F.col("level") == "error"
    empty = (F.col("rule") == "rows") & (F.col("n") == 0)
    return checks.agg(
        F.coalesce(F.max(F.when(F.col("rule") == "rows", F.col("n"))), F.lit(0)).cast("bigint").alias("rows"),
        F.count_if(is_err & ~F.col("rule").endswith("_value")).alias("n_errors"),
        F.count_if(F.col("level") == "warning").alias("n_warnings"),
        (~F.coalesce(F.bool_or(is_err | empty), F.lit(False))).alias("passed"))


def value_counts(df: DataFrame, fields=("category", "label")) -> DataFrame:
    """A2: ``(field, value, n)`` per field, descending counts."""
    parts = [df.groupBy(F.col(f).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
             .select(F.lit(f).alias("field"), "value", "n") for f in fields]
    return reduce(DataFrame.unionByName, parts).orderBy(F.col("field"), F.col("n").desc(), F.col("value"))
