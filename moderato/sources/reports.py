"""Metrics reports as JSON.

A report is one nested row: ``per_label`` is a map label -> struct of
precision, recall, f1, roc_auc (nullable) and support; ``overall`` is a
struct.  Reports are built from the long/per-label metric frames with
bounded aggregates (six labels) and written with ``write.json``; reading
one back gives the long ``(label, metric, value)`` form used by
``model_compare``.  A missing prior report means "no comparison".
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moderato.sources.csv import path_exists

LABEL_METRICS = T.StructType([
    T.StructField("precision", T.DoubleType()), T.StructField("recall", T.DoubleType()),
    T.StructField("f1", T.DoubleType()), T.StructField("roc_auc", T.DoubleType()),
    T.StructField("support", T.LongType()),
])
OVERALL = T.StructType([
    T.StructField("macro_f1", T.DoubleType()), T.StructField("micro_f1", T.DoubleType()),
    T.StructField("macro_roc_auc", T.DoubleType()), T.StructField("micro_roc_auc", T.DoubleType()),
    T.StructField("hamming_loss", T.DoubleType()), T.StructField("subset_accuracy", T.DoubleType()),
    T.StructField("n_test", T.LongType()),
])
REPORT = T.StructType([
    T.StructField("per_label", T.MapType(T.StringType(), LABEL_METRICS)),
    T.StructField("overall", OVERALL),
])


def build_report(per_label: DataFrame, overall: DataFrame) -> DataFrame:
    """One row ``(per_label, overall)`` from ``(label, precision, recall,
    f1, [roc_auc], support)`` rows and a one-row overall frame."""
    pl = per_label if "roc_auc" in per_label.columns else per_label.withColumn("roc_auc", F.lit(None).cast("double"))
    entry = F.struct(F.col("label").alias("key"), F.struct(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in LABEL_METRICS.fields]).alias("value"))
    m = pl.agg(F.map_from_entries(F.collect_list(entry)).alias("per_label"))
    ov = F.struct(*[(F.col(f.name) if f.name in overall.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                    for f in OVERALL.fields]).alias("overall")
    o = overall.select(ov)
    one = F.lit(1).alias("_one")
    return m.select("*", one).join(o.select("*", one), "_one").drop("_one")


def write_report(report: DataFrame, path: str) -> None:
    """A single JSON document (the report is one row)."""
    report.coalesce(1).write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame | None:
    """The prior report, or None when it does not exist."""
    if not path_exists(spark, path):
        return None
    return spark.read.schema(REPORT).json(path)


def report_long(report: DataFrame) -> DataFrame:
    """``(label, metric, value)``; overall metrics under label ``overall``."""
    pl = report.select(F.explode("per_label").alias("label", "m")).select(
        "label", F.expr("stack(5, 'precision', m.precision, 'recall', m.recall, 'f1', m.f1, "
                        "'roc_auc', m.roc_auc, 'support', cast(m.support as double)) as (metric, value)"))
    names = [f.name for f in OVERALL.fields]
    ov = report.select(F.lit("overall").alias("label"), F.expr(
        "stack({}, {}) as (metric, value)".format(
            len(names), ", ".join(f"'{n}', cast(overall.{n} as double)" for n in names))))
    return pl.unionByName(ov)


def report_label_metrics(report: DataFrame) -> DataFrame:
    """Per-label metric columns of a report, for ``model_compare``."""
    return report.select(F.explode("per_label").alias("label", "m")).select(
        "label", "m.precision", "m.recall", "m.f1", "m.roc_auc", "m.support")
