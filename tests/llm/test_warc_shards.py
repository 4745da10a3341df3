"""Shards of the WARC writer are even whatever the ids; readers check the manifest's digests."""
import pytest
from pyspark.sql import functions as F

from moderato.llm import warc


def _payload(i):
    return F.repeat(F.sha2(i.cast("string"), 256), 4)


@pytest.mark.parametrize("ids", ["far", "clusters", "one", "null"])
def test_shards_are_even_for_any_ids(spark, tmp_path, ids):
    rows = spark.range(4000).withColumn("html", _payload(F.col("id")))
    page = {"far": F.when(F.col("id") == 0, F.lit(1 << 60)).otherwise(F.col("id")),
            "clusters": F.col("id") % 4 * (1 << 50) + F.col("id"),
            "one": F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") + 10),
            "null": F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id"))}[ids]
    pages = rows.select(page.cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), "html")
    made = []
    for deal in (1, 7):
        uri = f"file://{tmp_path}/{deal}"
        manifest = warc.write_warc(pages.repartition(deal), uri, shard_bytes=64_000, roll_bytes=8_000)
        made.append(sorted((r.file, r.sha256, r.records) for r in manifest.collect()))
    assert made[0] == made[1]
    per = [r.n for r in manifest.groupBy("shard").agg(F.sum("records").alias("n")).collect()]
    assert len(per) == 16 and max(per) <= 251 and sum(per) == 4000      # 250 pages of 256 bytes each
    spans = [(r.lo, r.hi) for r in manifest.groupBy("shard").agg(F.min("first_id").alias("lo"), F.max("last_id").alias("hi")).orderBy("shard").collect()]
    known = [(lo, hi) for lo, hi in spans if lo is not None]
    assert all(a[1] <= b[0] for a, b in zip(known, known[1:], strict=False))
    got = warc.read_warc(manifest, uri)
    assert got.rdd.getNumPartitions() > 1
    want = pages.select("page_id", F.sha1("html").alias("payload_digest"))
    assert got.select("page_id", "payload_digest").exceptAll(want).count() == 0 and got.count() == 4000


def test_rows_that_are_equal_stay_in_one_shard(spark, tmp_path):
    pages = spark.range(500).select(F.lit(3).cast("long").alias("page_id"), F.lit("http://a").alias("url"), F.lit("x" * 2000).alias("html"))
    manifest = warc.write_warc(pages, f"file://{tmp_path}/e", shard_bytes=10_000, roll_bytes=1000)
    assert manifest.select("shard").distinct().count() == 1
    got = warc.read_warc(manifest, f"file://{tmp_path}/e")
    assert got.filter("record_type = 'response'").count() == 500


def test_a_wrong_manifest_digest_is_an_error(spark, tmp_path):
    uri = f"file://{tmp_path}/w"
    pages = spark.createDataFrame([(1, "u", "a" * 50), (2, "u", "b")], "page_id long, url string, html string")
    manifest = warc.write_warc(pages, uri)
    assert warc.read_warc(manifest, uri).count() == 2
    wrong = manifest.withColumn("sha256", F.sha2("sha256", 256))
    with pytest.raises(Exception, match="differs from the manifest"):
        warc.read_warc(wrong, uri).collect()
