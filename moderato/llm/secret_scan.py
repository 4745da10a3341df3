"""Secret scans with an incremental blob ledger (operator 13).

Every version of every path is addressed by the SHA-256 of its text, the blob.  The
ledger is two tables in a folder that all executors share: ``pairs`` (blob, rule, rule version) that were scanned,
and ``findings`` of these.  A run scans only pairs that the ledger lacks, adds what it
found, then the pairs, and joins all findings of the present rule versions to all
paths by blob.  A run that dies between the two leaves findings that the next run
makes again; they are read as a set.

Which texts to read is decided on ``(path, version, blob)`` alone, without texts.  A blob that one
row has and the ledger lacks is scanned where it lies.  Blobs that
several rows have or that the ledger knows in part go to one place each: a
text per blob is taken inside each task first, so a blob that a third of all rows share
moves once a task.  Two bitmaps over hashes of blobs tell tasks which is which; they are sized by
the count of such blobs and hold at most ``MAX_BITS`` bits.  A chance hit only sends a text
the longer way, where the exact table of open pairs decides.

Null texts are empty.  Each row gives one row, whatever its path and version, null
and repeated ones too; an empty table gives an empty result.  Texts are scanned
whole.  Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moderato.llm.common import documents, stage
from moderato.llm.secret_rules import BASE, RULES, Rule
from moderato.session import scratch_path

MAX_BITS = 1 << 29
_BUCKET = 1 << 15          # bits of one value of bitmap_construct_agg
_FINDING = "blob binary, rule string, rule_version int, start int, end int"
_PAIR = "blob binary, rule string, rule_version int"


class Ledger:
    """Scanned pairs and their findings below ``uri``."""

    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.uri = spark, uri
        for name, schema in (("findings", _FINDING), ("pairs", _PAIR)):   # a new ledger has both tables, empty
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{uri}/{name}")

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.uri}/{name}")

    @property
    def pairs(self) -> DataFrame:
        return self._table("pairs", _PAIR).distinct()

    @property
    def findings(self) -> DataFrame:
        return self._table("findings", _FINDING).distinct()

    def add(self, findings: DataFrame, pairs: DataFrame) -> None:
        """Findings first: a pair in the ledger has all of its findings there."""
        findings.write.mode("append").parquet(f"{self.uri}/findings")
        pairs.write.mode("append").parquet(f"{self.uri}/pairs")


def _bits(states: DataFrame, size: int) -> np.ndarray:
    """The bitmap of the column ``at`` of ``states``, at most ``MAX_BITS / 8`` bytes."""
    parts = (states.select((F.col("at") + 1).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect())
    out = np.zeros(size // 8, np.uint8)
    for bucket, bits in parts:
        lo = (bucket - 1) * _BUCKET // 8
        part = np.frombuffer(bits, np.uint8)[:size // 8 - lo]
        out[lo:lo + len(part)] = part
    return out


def _set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7)) & 1 == 1


def _found(blobs: list[bytes], texts: list[str], todo: list[list[Rule]]) -> pa.RecordBatch:
    out = [(blob, rule.name, rule.version, a, b) for blob, text, rules in zip(blobs, texts, todo, strict=True) for rule in rules for a, b in rule.find(text)]
    types = [pa.binary(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array([row[i] for row in out], t) for i, t in enumerate(types)],
                                      names=["blob", "rule", "rule_version", "start", "end"])


def _in_place(shared, rules: tuple[Rule, ...]):
    """Scans rows whose blob is new and nobody else's."""
    def run(batches):
        again = shared.value[0]
        for batch in batches:
            new = batch.filter(pa.array(~_set(again, batch.column(1).to_numpy())))
            yield _found(new.column(0).to_pylist(), new.column(2).to_pylist(), [rules] * len(new))
    return run


def _open(shared):
    """Rows whose blob may be repeated or known in part, and may have an open pair."""
    def run(batches):
        work = shared.value[1]
        for batch in batches:
            yield batch.filter(pa.array(_set(work, batch.column(1).to_numpy()))).select(["blob", "text"])
    return run


def _by_todo(rules: tuple[Rule, ...]):
    named = {r.name: r for r in rules}

    def run(batches):
        for batch in batches:
            yield _found(batch.column(0).to_pylist(), batch.column(1).to_pylist(), [[named[n] for n in t] for t in batch.column(2).to_pylist()])
    return run


def scan_versions(versions: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES, path_col: str = "path", version_col: str = "version",
                  text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``versions``: path and version, ``blob`` (hex) and ``findings``, an
    array of (rule, start, end) by start, then in the order of ``rules``.  The ledger then
    holds all pairs of these blobs and rules."""
    if len({r.name for r in rules}) < len(rules):
        raise ValueError("two rules have one name")
    spark = versions.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = versions.select(F.col(path_col).alias("path"), F.col(version_col).alias("version"), text.alias("text"))
    rows = rows.withColumn("blob", F.unhex(F.sha2("text", 256)))
    thin = stage(rows.select("path", "version", "blob"), "versions")

    present = spark.createDataFrame([(r.name, r.version, i) for i, r in enumerate(rules)], "rule string, rule_version int, place int")
    names = F.array(*[F.lit(r.name) for r in rules]) if rules else F.array().cast("array<string>")
    blobs = thin.groupBy("blob").agg(F.count(F.lit(1)).alias("n"))
    seen = ledger.pairs.join(F.broadcast(present), ["rule", "rule_version"]).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    state = blobs.join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    state = stage(state.select("blob", ((F.col("n") > 1) | (F.size("seen") > 0)).alias("again"), F.array_except(names, "seen").alias("todo")), "blobs")

    many = state.filter("again").count()
    size = min(max_bits, max(_BUCKET, 1 << (16 * many).bit_length()))
    at: Column = F.xxhash64("blob").bitwiseAND(F.lit(size - 1))
    places = state.select(at.alias("at"), "again", (F.size("todo") > 0).alias("work"))
    places = places.groupBy("at").agg(F.bool_or("again").alias("again"), F.bool_or("work").alias("work")).filter("again")
    places = stage(places, "places")
    shared = spark.sparkContext.broadcast((_bits(places, size), _bits(places.filter("work"), size)))

    ins = rows.select("blob", at.alias("at"), "text")
    alone = ins.mapInArrow(_in_place(shared, rules), _FINDING)
    gathered = ins.mapInArrow(_open(shared), "blob binary, text string").groupBy("blob").agg(F.first("text").alias("text"))
    gathered = gathered.join(state.filter(F.size("todo") > 0).select("blob", "todo"), "blob")
    new = stage(alone.unionByName(gathered.mapInArrow(_by_todo(rules), _FINDING)), "findings")
    old = ledger.findings.join(seen.select("blob"), "blob", "left_semi")
    pairs = state.select("blob", F.explode("todo").alias("rule")).join(F.broadcast(present), "rule").select("blob", "rule", "rule_version")
    ledger.add(new, pairs)

    every = new.unionByName(old).distinct().join(F.broadcast(present), ["rule", "rule_version"])
    of_blob = every.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "place", "rule", "end"))).alias("findings"))
    told = thin.join(of_blob, "blob", "left")
    kind = "array<struct<rule:string,start:int,end:int>>"
    return told.select(F.col("path").alias(path_col), F.col("version").alias(version_col), F.lower(F.hex("blob")).alias("blob"),
                       F.coalesce(F.transform("findings", lambda f: F.struct(f["rule"].alias("rule"), f["start"].alias("start"), f["end"].alias("end"))),
                                  F.array().cast(kind)).alias("findings"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document of ``documents``: ``doc_id``, base counts by kind, ``base_sha256`` and
    ``spans``, through a new ledger in which each document is a path with one version."""
    docs = documents(spark, sf_dir).select("doc_id", F.lit(0).alias("version"), "text")
    out = scan_versions(docs, Ledger(spark, scratch_path(spark, "secret-ledger")), path_col="doc_id")
    base = [r.name for r in BASE]
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["rule"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda names: F.filter("findings", lambda s: s["rule"].isin(names))
    counts = [F.size(of([k])).cast("long").alias(f"n_{k}") for k in base]
    return out.select("doc_id", *counts, F.sha2(line(of(base)), 256).alias("base_sha256"), line("findings").alias("spans"))
