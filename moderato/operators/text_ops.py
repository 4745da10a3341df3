"""Table-level text operators: language evidence and mix, lexicon hits,
line splitting of pasted blocks (F3, J4, A20, S9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moderato.functions.language import decide_language, language_evidence
from moderato.functions.lexicon import lexicon_table
from moderato.functions.text import strip, tokens
from moderato.operators.features import run_lengths
from moderato.schema import MAX_BATCH_SIZE


def with_language(df: DataFrame, text_col: str = "text", default: str = "en") -> DataFrame:
    """Adds ``en_score, sn_score, language`` (token evidence and decision)."""
    ev = df.withColumn("_tokens", tokens(F.col(text_col))).withColumn("_ev", language_evidence(toks=F.col("_tokens")))
    return (ev.withColumn("en_score", F.col("_ev.en")).withColumn("sn_score", F.col("_ev.sn"))
            .withColumn("language", decide_language(F.col("_ev"), default)).drop("_tokens", "_ev"))


def language_mix(df: DataFrame, text_col: str = "text", by: list[str] | None = None) -> DataFrame:
    """Rows per (group keys, detected language); partial aggregation first."""
    return with_language(df, text_col).groupBy(*(by or []), "language").agg(F.count(F.lit(1)).alias("n"))


def lexicon_hits(df: DataFrame, text_col: str = "text", lexicon: DataFrame | None = None) -> DataFrame:
    """J4 as a join: every token against a lexicon table ``(term, kind)``.

    The lexicon side is broadcast only when it is the bounded built-in table
    (a few hundred rows) or when the caller passes one; Spark's own size
    check (autoBroadcastJoinThreshold) still decides for a caller's table.
    Output: ``kind, term, hits, docs``.  A row's own occurrences of a term are counted first, without a shuffle, so
    hits and documents are plain sums: partial aggregation leaves one row
    per task for a hot term."""
    builtin = lexicon is None
    lex = (lexicon if lexicon is not None else lexicon_table(df.sparkSession)).select("term", "kind").distinct()
    toks = df.select(tokens(F.col(text_col)).alias("_t")).select(F.array_sort("_t").alias("_s"))
    each = toks.select(F.explode_outer(run_lengths(F.col("_s"))).alias("_r"))
    counted = each.select("_r.term", F.col("_r.tf").alias("n")).filter(F.col("term").isNotNull())
    j = counted.join(F.broadcast(lex) if builtin else lex, "term")
    return j.groupBy("kind", "term").agg(F.sum("n").cast("long").alias("hits"), F.count(F.lit(1)).alias("docs"))


def split_lines(df: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                max_items: int = MAX_BATCH_SIZE) -> DataFrame:
    """One comment per non-blank, trimmed line of a pasted block.

    The line count is computed on the row before exploding, so the batch
    limit needs no shuffle.  Output: ``id, line_no (0-based among kept
    lines), line, n_lines, accepted``."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), strip),
                     lambda x: F.length(x) > 0)
    base = df.select(F.col(id_col), lines.alias("_lines"))
    base = base.withColumn("n_lines", F.size("_lines")).withColumn(
        "accepted", (F.col("n_lines") >= 1) & (F.col("n_lines") <= max_items))
    # posexplode_outer + null filter keeps Spark from inferring a size filter
    # and pushing the line splitting below an upstream repartition.
    return base.select(id_col, F.posexplode_outer("_lines").alias("line_no", "line"), "n_lines", "accepted") \
        .filter(F.col("line").isNotNull())
