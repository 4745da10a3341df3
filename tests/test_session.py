"""The session guard against a union's claim of a common partitioning."""

from pyspark.sql import functions as F

from moderato.session import safe_unions
from moderato.sources import fixtures as fx


def test_grouping_after_a_union_of_shuffled_tables(spark):
    safe_unions(spark)
    assert spark.conf.get("spark.sql.unionOutputPartitioning") == "false"
    a = fx.annotated(spark, "/root/testdata/sf0.01").select("doc_id")
    twice = a.unionByName(a.filter(F.col("doc_id") % 11 == 5)).groupBy("doc_id").count()
    b = twice.join(twice.withColumnRenamed("count", "n"), "doc_id")
    assert b.filter("count = 1").count() + b.filter("count = 2").count() == a.distinct().count()
