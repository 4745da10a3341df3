"""The stages of ``corpus_pipeline``: each applies one operator to the documents that
its predecessor kept.  All but the last return the columns they got, under
the same names, whatever else these columns hold.

Rows without an id can't be compared by id:  language identification and
personal data treat them like all others, the join and decontamination let them
pass, packing packs them.  An empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moderato.llm.decontaminate import contaminated
from moderato.llm.hd_language import UNDETERMINED, learn_from, predict_language, unused
from moderato.llm.ngram_join import jaccard_classes
from moderato.llm.packing import pack_documents
from moderato.llm.pii import learn, redact


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a predicted language, which becomes their ``lang``;
    those that are null or have no letter are rejected."""
    lang, score = unused(docs, "told"), unused(docs, "told_score")
    told = predict_language(docs, learn_from(docs), lang_out=lang, score_out=score)
    return told.filter(F.col(lang) != UNDETERMINED).withColumn("lang", F.col(lang)).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by similarity the document with the smallest id.  Where
    rows repeat an id, the one with the smallest text stays."""
    classes = jaccard_classes(docs.select("doc_id", "text"))
    heads = classes.filter("id = component").select(F.col("id").alias("doc_id"))
    kept = docs.join(heads, "doc_id", "left_semi")
    if kept.groupBy("doc_id").count().filter("count > 1").head(1):
        rest = [c for c in docs.columns if c not in ("doc_id", "text")]
        kept = kept.groupBy("doc_id").agg(F.min(F.struct("text", *rest)).alias("r")).select("doc_id", "r.*")
    return kept.select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    found = contaminated(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_anti").select(*docs.columns)


def clean_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; ``n_chars`` is counted anew."""
    clean = redact(docs, learn(docs))
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return pack_documents(docs).drop("uid")
