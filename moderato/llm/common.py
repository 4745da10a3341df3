"""Shared steps of the operators: staged tables and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moderato.session import scratch_path, shuffles_dropped  # noqa: F401


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet below the session's shared checkpoint folder and
    reads it back: the lineage is cut and lost executors lose nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(staged: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more: what was made of it is staged itself."""
    spark = staged.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged.staged_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


SIEVE_BITS = 1 << 27    # at most, of a sieve: 16 MB


def sieve(rows: DataFrame, col: str, wanted: DataFrame, max_bits: int = SIEVE_BITS) -> DataFrame:
    """The rows whose ``col`` is one of ``wanted``'s, and a few others: a bitmap over hashes, sized by the
    count of ``wanted`` up to ``max_bits``, is broadcast in place of it, so the rows aren't shuffled."""
    size = min(max_bits, max(1 << 15, 1 << (8 * wanted.count()).bit_length()))
    at = F.xxhash64(col).bitwiseAND(F.lit(size - 1))
    bits = wanted.select((at + 1).alias("_at")).groupBy((F.bitmap_bucket_number("_at") - 1).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits"))
    placed = rows.withColumns({"_bucket": F.shiftright(at, 15), "_place": at.bitwiseAND(F.lit((1 << 15) - 1)).cast("int")})
    byte = F.expr("cast(conv(hex(substring(_bits, shiftright(_place, 3) + 1, 1)), 16, 10) AS int)")
    hit = F.expr("shiftright(_byte, _place & 7) & 1 = 1")
    found = placed.join(F.broadcast(bits), "_bucket").withColumn("_byte", byte).filter(hit)
    return found.select(*rows.columns)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def one_text_per_id(every: DataFrame) -> DataFrame:
    """``id, text`` with one row for each id: where rows repeat an id, the
    smallest of its texts stands for them.  Rows without an id all stay."""
    if not every.groupBy("id").count().filter("count > 1 AND id IS NOT NULL").head(1):
        return every
    ids = every.filter("id IS NOT NULL").groupBy("id").agg(F.min("text").alias("text"))
    return every.filter("id IS NULL").unionByName(ids)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every end of an edge: the smallest node reachable.

    Alternating large-star and small-star steps: each hangs neighbours on
    the smallest known node, by one grouped minimum and one join, until only
    stars are left, whose centres are smaller than what hangs on them.  Every pass is staged, so the lineage stays short; no node's
    neighbours are ever gathered."""
    both = (edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    cur = stage(both, "edges")
    while True:
        ends = cur.select("u", F.lit(1).alias("up")).unionByName(cur.select(F.col("v").alias("u"), F.lit(0).alias("up")))
        mixed = ends.groupBy("u").agg(F.sum("up").alias("ups"), F.min("up").alias("low")).filter("ups > 1 OR ups = 1 AND low = 0")
        if not mixed.head(1):
            break
        # large star: larger neighbours of u hang on the smallest of u and its neighbours
        sym = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = (sym.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        # small star: u and its smaller neighbours hang on the smallest of these
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = hung.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v")
        cur = stage(small.distinct(), "edges")
    top = cur.groupBy("u").agg(F.min("v").alias("component"))
    roots = top.select(F.col("component").alias("node")).distinct()
    return top.select(F.col("u").alias("node"), "component").unionByName(
        roots.select("node", F.col("node").alias("component")))

