"""Benchmark decontamination (operator 3), in DataFrame functions alone.

1. Hits.  One pass over all texts joins the hashes of their shingles with those of the items.
   Only (text, position, hash) of hits goes on: no text is moved.  A
   window that holds ``SIMILARITY`` of an item's weight lacks the rest at
   most, so it holds one at least of any of the item's shingles that weigh more than
   that together.  The heaviest are taken (those that fewest items share, so a common
   template brings no candidates); in a text with one of them every hit of the item's shingles, at word p of
   the text and word q of the item, aligns a window of the item's size at word p - q.
2. Fingerprints.  Windows and items have a 64-bit SimHash of their weighted shingles: of the
   window those that some item has, each with its weight.  A shingle that n items share weighs
   1 / n, so boilerplate counts less, here as in the verification.
3. Multi-index Hamming blocks.  The 64 bits are cut into one block more than the radius; two
   fingerprints within the radius agree in one block at least, so an equality
   join on (item, block, bits) finds all such pairs; the distance is then checked.  Only
   these are candidates.  The radius follows from the similarity (``radius_of``): a window that holds the part s of an item's weight lies
   at the angle acos(sqrt(s)), each bit differs with that angle over pi, and three deviations above the
   mean leave out about one window in a thousand right at the threshold, fewer above it.
4. Verification.  A candidate's similarity is the weight of the item's distinct shingles
   that the window holds, of their whole weight, summed in whole numbers.  From ``SIMILARITY``
   on the text is contaminated by the item.

Words are runs of letters and digits, lower-cased; shingles are compared by 64-bit hashes.  Items with fewer than five
words are one shingle of all of them; texts and items without words match nothing.
Null texts are empty.  Rows that repeat an id get the same row each, from all their
texts; a null id is never contaminated.  Repeated items count by their id's smallest
text.  The item tables are broadcast only if counted and within a limit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moderato.llm.common import documents, stage

K = 5
SIMILARITY = 0.8
UNIT = 1 << 40                   # weight of a shingle that one item has
BROADCAST_BYTES = 64 << 20       # counted size of an item table up to which it is broadcast


def radius_of(similarity: float) -> int:
    """Bits in which the fingerprints of an item and of a window with ``similarity`` differ: the mean and three deviations."""
    p = math.acos(math.sqrt(similarity)) / math.pi
    return math.ceil(64 * p + 3 * math.sqrt(64 * p * (1 - p)))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(w: str, k: str) -> str:
    """SQL for the k-word shingles of the array column ``w``, as arrays."""
    return f"transform(sequence(1, size({w}) - {k} + 1), i -> slice({w}, i, {k}))"


def simhash(features: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``fingerprint``: the 64-bit SimHash of the hashes ``h`` with the weights ``units``."""
    bit = lambda b: F.call_function("shiftrightunsigned", F.col("h"), F.lit(b)).bitwiseAND(F.lit(1).cast("long")) == 1
    sums = features.groupBy(*keys).agg(*[F.sum(F.when(bit(b), F.col("units")).otherwise(-F.col("units"))).alias(f"_{b}") for b in range(64)])
    made = F.lit(0).cast("long")
    for b in range(64):
        mask = 1 << b if b < 63 else -(1 << 63)
        made = made.bitwiseOR(F.when(F.col(f"_{b}") > 0, F.lit(mask).cast("long")).otherwise(F.lit(0).cast("long")))
    return sums.select(*keys, made.alias("fingerprint"))


def blocks(fingerprint: Column, radius: int) -> Column:
    """``(block, bits)`` of the radius + 1 blocks of a fingerprint."""
    n = radius + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return F.array(*[F.struct(F.lit(i).alias("block"),
                              F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1 if n > 1 else -1).cast("long")).alias("bits"))
                     for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))])


def _small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def prepared_items(items: DataFrame, item_col: str, text_col: str, k: int) -> DataFrame:
    """``item, words, k`` of the items that have words."""
    one = (items.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text"))
           .filter("item IS NOT NULL").groupBy("item").agg(F.min("text").alias("text")))
    out = one.select("item", words(F.col("text")).alias("words")).filter("size(words) > 0")
    return out.select("item", "words", F.least(F.lit(k), F.size("words")).alias("k"))


def item_shingles(items: DataFrame, item_col: str, text_col: str, k: int) -> DataFrame:
    """``item, size, k, q, h, units``: each place q of a shingle in an item, with the shingle's weight."""
    bench = prepared_items(items, item_col, text_col, k)
    gram = bench.select("item", F.size("words").alias("size"), "k", F.posexplode(F.expr(_shingles("words", "k"))).alias("q", "shingle"))
    gram = gram.select("item", "size", "k", "q", F.xxhash64("k", "shingle").alias("h"))
    shared_by = gram.groupBy("h").agg(F.expr(f"{UNIT}L div count(DISTINCT item)").alias("units"))
    return stage(gram.join(shared_by, "h").select("item", "size", "k", "q", "h", "units"), "item-shingles")


def windows(docs: DataFrame, gram: DataFrame, n_grams: int, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """``uid, id, item, start, h, units``: the shingles that items have of every aligned window."""
    weighed = gram.select("item", "h", "units").distinct()
    whole = weighed.groupBy("item").agg(F.sum("units").alias("whole"))
    heavy = Window.partitionBy("item").orderBy(F.desc("units"), "h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    needed = (weighed.withColumn("before", F.sum("units").over(heavy) - F.col("units")).join(_small(whole, n_grams, 16), "item")
              .filter(F.col("before") <= (1 - similarity + 1e-6) * F.col("whole")).select("h", "item"))
    lengths = sorted(r[0] for r in gram.select("k").distinct().collect())       # at most the shingle length
    widest = gram.agg(F.max("size")).first()[0] or 1
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id IS NOT NULL")
    spoken = text.select(F.monotonically_increasing_id().alias("uid"), "id", words(F.col("text")).alias("w"))
    known = gram.select("h", "k", "units").distinct()
    places = []
    for n in lengths:        # one pass for each shingle length: 5, and less only where an item is shorter
        h = f"CASE WHEN size(w) >= {n} THEN transform(sequence(1, size(w) - {n - 1}), i -> xxhash64({n}, slice(w, i, {n}))) END"
        part = spoken.select("uid", "id", F.posexplode_outer(F.expr(h)).alias("p", "h")).filter("h IS NOT NULL")
        places.append(part.join(_small(known.filter(F.col("k") == n), n_grams, 32), "h"))
    hits = places[0] if places else spoken.select("uid", "id", F.lit(0).alias("p"), F.lit(0).cast("long").alias("h")).limit(0).join(known, "h")
    for part in places[1:]:
        hits = hits.unionByName(part)
    hits = stage(hits.select("uid", "id", "p", "h", "k", "units"), "hits")
    pairs = hits.join(_small(needed, n_grams, 24), "h").select("uid", "item").distinct()
    aligned = (hits.select("uid", "p", "h").join(_small(gram.select("h", "item", "q", "size"), n_grams, 48), "h").join(pairs, ["uid", "item"], "left_semi")
               .select("uid", "item", F.greatest(F.col("p") - F.col("q"), F.lit(0)).alias("start"), "size").distinct())
    # Hits meet windows through stretches of the widest item's size: a window lies in two of them.
    at = F.expr(f"start div {widest}")
    spread = aligned.withColumn("at", F.explode(F.array(at, at + 1)))
    inside = hits.withColumn("at", F.expr(f"p div {widest}")).join(spread, ["uid", "at"]).filter("p >= start AND p + k <= start + size")
    return inside.select("uid", "id", "item", "start", "h", "units").distinct()


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text", k: int = K, similarity: float = SIMILARITY, radius: int | None = None) -> DataFrame:
    """``id, item, start, similarity``: for each contaminated text and item the
    best window (its first word, from 0)."""
    radius = radius_of(similarity) if radius is None else radius
    gram = item_shingles(items, item_col, item_text_col, k)
    n_grams = gram.count()
    weighed = gram.select("item", "h", "units").distinct()
    features = stage(windows(docs, gram, n_grams, id_col, text_col, similarity), "windows")

    place = ["uid", "id", "item", "start"]
    prints = simhash(features, place)
    own = simhash(weighed, ["item"]).withColumnRenamed("fingerprint", "item_print")
    index = own.select("item", "item_print", F.explode(blocks(F.col("item_print"), radius)).alias("at"))
    probe = prints.select(*place, "fingerprint", F.explode(blocks(F.col("fingerprint"), radius)).alias("at"))
    near = (probe.join(_small(index, n_grams * (radius + 1), 64), ["item", "at"])
            .filter(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_print"))) <= radius).select(*place).distinct())

    whole = weighed.groupBy("item").agg(F.sum("units").alias("whole"))
    held = (features.join(near, place, "left_semi").join(_small(weighed.select("item", "h"), n_grams, 24), ["item", "h"])
            .groupBy(*place).agg(F.sum("units").alias("held")))
    scored = held.join(_small(whole, n_grams, 16), "item").select("id", "item", "start", (F.col("held") / F.col("whole")).alias("similarity"))
    best = scored.filter(F.col("similarity") >= similarity - 1e-9).groupBy("id", "item").agg(
        F.max_by(F.struct("similarity", "start"), F.struct("similarity", -F.col("start"))).alias("b"))
    return best.select("id", "item", "b.start", F.round("b.similarity", 9).alias("similarity"))


def contamination_report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """One row per row of ``docs``: ``id, contaminated, n_items, item_ids, similarity``."""
    found = contaminated(docs, items, id_col, **how).groupBy("id").agg(
        F.count(F.lit(1)).alias("n_items"), F.sort_array(F.collect_list("item")).alias("item_ids"), F.max("similarity").alias("similarity"))
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    return ids.join(found, "id", "left").select(
        "id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.array_join(F.transform(F.coalesce("item_ids", F.array().cast("array<long>")), lambda x: x.cast("string")), ",").alias("item_ids"),
        F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: ``doc_id, contaminated, n_items, item_ids, similarity``."""
    out = contamination_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.withColumnRenamed("id", "doc_id")
