"""Views over the driver's tables that stand in for the reference's inputs.

The test tables have no categories, severities or scores, so they are derived
deterministically (the same formulas are written in the DuckDB oracles):

* ``comments``  = documents(doc_id, text, lang, source)
* ``annotated`` = documents joined with labels; label from ``toxic``, category
  = entry ``doc_id % 17`` of the 17 category names in alphabetical order,
  severity = ``doc_id % 5`` on toxic rows, else 0.
* ``scored``    = per label, the first 4 hex digits of md5(label:id) / 65535.
* random order  = md5('42:' || id), then id.
* ``lines``     = every line of every document, ``id = doc_id * 1000000 + line``.
* ``mixed``     = lines of which half carry markers, slurs, greetings, blanks or NULL, chosen by a hash of the id.
* ``drawn``     = lines with six labels, a -1 sentinel and a given split, all from digits of a hash.
* ``raw_annotated`` = annotated rows of which a part breaks a rule of the validator.
* ``filed``     = annotated rows dealt to CSV file names, reserved ones and the starter template among them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moderato.functions import lexicon as lx
from moderato.functions.lexicon import VALID_CATEGORIES
from moderato.operators.text_ops import split_lines
from moderato.schema import LABELS, SEED

SPREAD_MAX_BYTES = 64 << 20    # files up to this size in all are dealt anew to every core


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files below ``path`` (any Hadoop file system)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(p).getLength())


def table(spark: SparkSession, sf_dir: str, name: str, key: str | None = None) -> DataFrame:
    """A table of ``sf_dir``.  A single small file gives one split, so up to
    ``SPREAD_MAX_BYTES``, measured, its rows are dealt to all cores (by ``key``, which later
    steps on that key can reuse); larger tables are read as they lie, whatever the cluster."""
    path = f"{sf_dir}/{name}.parquet"
    df = spark.read.parquet(path)
    if stored_bytes(spark, path) > SPREAD_MAX_BYTES:
        return df
    target = spark.sparkContext.defaultParallelism
    return df.repartition(target, key) if key else df.repartition(target)


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", key="doc_id").select("doc_id", "text", "lang", "source")


def category_of(doc_id: Column) -> Column:
    cats = F.array(*[F.lit(c) for c in VALID_CATEGORIES])
    return F.element_at(cats, (F.pmod(doc_id, F.lit(len(VALID_CATEGORIES))) + 1).cast("int"))


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2-shaped rows: ``doc_id, text, lang, source, label, category, severity``.

    documents x labels is a key-to-key join on ``doc_id``.  No broadcast is
    forced: labels grows with the data, so Spark's own size check (and AQE
    at runtime) broadcasts it only while it is small, and otherwise runs a
    sort-merge join on the co-partitioned sides."""
    # Both sides spread by doc_id (when spread at all) are co-partitioned, so
    # the join adds no exchange of its own.
    docs = table(spark, sf_dir, "documents", key="doc_id").select("doc_id", "text", "lang", "source")
    labs = table(spark, sf_dir, "labels", key="doc_id").select("doc_id", "toxic", "quality")
    j = docs.join(labs, "doc_id")
    tox = F.col("toxic") == 1
    return j.select(
        "doc_id", "text", "lang", "source", "quality",
        F.when(tox, F.lit("toxic")).otherwise(F.lit("non-toxic")).alias("label"),
        category_of(F.col("doc_id")).alias("category"),
        F.when(tox, F.pmod(F.col("doc_id"), F.lit(5))).otherwise(F.lit(0)).cast("int").alias("severity"),
    )


def fixture_score(label: str, id_col: Column) -> Column:
    h = F.substring(F.md5(F.concat_ws(":", F.lit(label), id_col.cast("string"))), 1, 4)
    return F.conv(h, 16, 10).cast("double") / F.lit(65535.0)


def fixture_scores(id_col: Column) -> dict[str, Column]:
    return {l: fixture_score(l, id_col) for l in LABELS}


def comment_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1-shaped rows ``(doc_id, comment_text, <6 labels>)``: labels mapped
    from the annotation (P4); rows of quality 0 carry the -1 sentinel
    ("excluded from scoring")."""
    from moderato.functions.labels import category_labels
    a = annotated(spark, sf_dir)
    labs = category_labels(F.col("category"), F.col("severity"), F.col("label") == "toxic")
    excluded = F.col("quality") == 0
    return a.select("doc_id", F.col("text").alias("comment_text"),
                    *[F.when(excluded, F.lit(-1)).otherwise(labs[l]).alias(l) for l in LABELS])


def digits_of(tag: str, id_col: Column, first: int, n: int = 1) -> Column:
    """``n`` hex digits of md5(tag:id) from the ``first`` (from 0) on, as a number."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{tag}:"), id_col.cast("string"))), first + 1, n), 16, 10).cast("int")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, text, lang, source``: one comment per line of each document."""
    docs = comments(spark, sf_dir)
    out = split_lines(docs.withColumn("doc_id", F.struct("doc_id", "lang", "source")))
    return out.select((F.col("doc_id.doc_id") * 1000000 + F.col("line_no")).alias("id"), F.col("line").alias("text"),
                      F.col("doc_id.lang").alias("lang"), F.col("doc_id.source").alias("source"))


_SLURS = list(lx.SLUR_FLOORS)
#: Of 24 hash values the first 12 change a line: whether its text stays in front, and what is added (None: the text is NULL).
MIXED = [
    (True, lx.EN_MARKERS), (True, lx.SN_MARKERS), (True, _SLURS), (False, [f"iwe {t}" for t in _SLURS]),
    (False, [f"{t} shamwari" for t in lx.BENIGN_TOKENS[:9]]), (False, ["mhoro yo", "mhoro i wo"]), (False, ["mhoro benzi", "shamwari imbwa"]),
    (False, [""]), (False, [" \t\n "]), (False, None), (False, ["mhoro " * 11]), (True, [f"{t.upper()}!" for t in _SLURS]),
]
MIXED_OF = 24


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, text, lang, source``: lines, half of them changed so that every lexical rule has rows."""
    df = lines(spark, sf_dir)
    h = digits_of("mix", F.col("id"), 0, 4)
    text = F.col("text")
    for v, (keep, phrases) in reversed(list(enumerate(MIXED))):
        if phrases is None:
            new = F.lit(None).cast("string")
        else:
            phrase = F.element_at(F.array(*[F.lit(p) for p in phrases]), (F.floor(h / MIXED_OF) % len(phrases) + 1).cast("int"))
            new = F.concat(F.col("text"), F.lit(" "), phrase) if keep else phrase
        text = F.when(h % MIXED_OF == v, new).otherwise(text)
    return df.withColumn("text", text)


#: Of 16 values of a digit, how many make a label 1, in the order of the labels.
DRAWN_RATES = [3, 2, 2, 2, 2, 2]


def drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, comment_text, <6 labels>, given``: lines as a labelled comment table in three given
    splits; one row in 16 is unscored (-1 in every label)."""
    df = lines(spark, sf_dir)
    digit = lambda i: digits_of("drawn", F.col("id"), i)
    unscored = digit(7) == 0
    labs = [F.when(unscored, F.lit(-1)).otherwise((digit(j) < r).cast("int")).alias(l) for j, (l, r) in enumerate(zip(LABELS, DRAWN_RATES, strict=True))]
    given = F.when(digit(8) < 2, F.lit("validation")).when(digit(8) < 4, F.lit("test")).otherwise(F.lit("train"))
    return df.select("id", F.col("text").alias("comment_text"), *labs, given.alias("given"))


def raw_annotated(spark: SparkSession, sf_dir: str, numeric: bool = True) -> DataFrame:
    """``doc_id, text, label, category, severity (string), source_lemma``, by ``doc_id % 29`` with
    missing, unknown and out-of-range values; without ``numeric`` also severities that are no numbers."""
    a = annotated(spark, sf_dir)
    k = F.col("doc_id") % 29
    severity = F.when(k == 5, "9").when(k == 6, "2.5").when(k == 7, "-1")
    if not numeric:
        severity = severity.when(k == 10, "x").when(k == 11, F.lit(None).cast("string")).when(k == 12, "2f")
    return a.select(
        "doc_id", F.when(k == 0, F.lit(None)).when(k == 9, F.lit("the same text again")).otherwise(F.col("text")).alias("text"),
        F.when(k == 1, F.lit("Toxic")).when(k == 2, F.lit(None)).otherwise(F.col("label")).alias("label"),
        F.when(k == 3, F.lit("unknown_kind")).when(k == 4, F.lit(None)).otherwise(F.col("category")).alias("category"),
        severity.otherwise(F.col("severity").cast("string")).alias("severity"),
        F.when(k == 8, F.lit(None)).otherwise(F.col("source")).alias("source_lemma"))


def filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated rows with ``_file`` and a string ``severity``: most sources are a file of their
    name; src0 is the reserved ``full.csv``, English src1 and the other rows of src1 are
    starter templates in two folders (with more and with fewer than 15 rows, or as the data has it),
    src2 has one severity that isn't a number in each language, src3 one that is beyond INT."""
    a = annotated(spark, sf_dir)
    src = F.col("source")
    name = (F.when(src == "src0", F.lit("/data/native/full.csv"))
            .when(src == "src1", F.when(F.col("lang") == "en", F.lit("/data/native/custom_shona_template.csv"))
                  .otherwise(F.concat(F.lit("/data/"), F.col("lang"), F.lit("/custom_shona_template.csv"))))
            .otherwise(F.concat(F.lit("/data/native/"), src, F.lit(" "), F.coalesce("lang", F.lit("")), F.lit(".csv"))))
    severity = (F.when((src == "src2") & (F.col("doc_id") % 3 == 0), F.lit("2x")).when((src == "src3") & (F.col("doc_id") % 5 == 0), F.lit("99999999999"))
                .otherwise(F.col("severity").cast("string")))
    return a.withColumn("_file", name).withColumn("severity", severity)
