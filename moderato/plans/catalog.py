"""Named queries: each takes ``(spark, sf_dir)`` and returns a DataFrame built
from the driver's tables (never from made-up input), so its work grows with
the data.  Column names match the DuckDB oracles in ``oracles``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moderato.operators.score import batch_summary, moderate, score_col
from moderato.schema import LABELS
from moderato.sources import fixtures as fx

QUERIES: dict = {}


def query(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _r(c, digits=6):
    return F.round(c, digits)


def moderated_view(df: DataFrame, key: str) -> DataFrame:
    """Flatten a moderated frame for comparison: scores, joined flags."""
    return df.select(
        key, "language", "model",
        *[F.col(score_col(l)).alias(f"s_{l}") for l in LABELS],
        F.array_join("flagged_labels", ",").alias("flagged"),
        "is_toxic",
    )


@query("moderate_auto")
def q_moderate_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U6 on every document: detect language, route, score, flag."""
    m = moderate(fx.comments(spark, sf_dir), "text", language="auto")
    return moderated_view(m, "doc_id")


@query("batch_summary")
def q_batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18 per conversation: every turn moderated (auto language)."""
    conv = fx.table(spark, sf_dir, "conversations")
    m = moderate(conv, "text", language="auto")
    return batch_summary(m, ["conv_id"])


# ------------------------------------------------------------ text & language
from moderato.functions import lexicon as lx  # noqa: E402
from moderato.functions.labels import any_positive, category_labels, label_sum, scored_row  # noqa: E402
from moderato.functions.text import (clean_text, is_scoreable, sigmoid, tokens,  # noqa: E402
                                     truncate_for_translation)
from moderato.functions.thresholds import (flagged_labels, normalize_thresholds,  # noqa: E402
                                           resolve_thresholds)
from moderato.operators import requests as rq  # noqa: E402
from moderato.operators import text_ops  # noqa: E402
from moderato.operators.score import (ConstantScorer, MarkerScorer, PandasScorer,  # noqa: E402
                                      ShonaScorer, benign_whitelisted, marker_predictor,
                                      marker_mapper, observed_write, score_batch, shona_adjust, slur_floors)


def _docs(spark, sf_dir):
    return fx.comments(spark, sf_dir)


@query("clean_text")
def q_clean_text(spark, sf_dir):
    """F1 over every document."""
    return _docs(spark, sf_dir).select("doc_id", clean_text("text").alias("clean"))


@query("tokens")
def q_tokens(spark, sf_dir):
    """F2 over every document."""
    t = tokens("text")
    return _docs(spark, sf_dir).select("doc_id", F.size(t).alias("n_tokens"),
                                       F.array_join(t, " ").alias("tokens"))


@query("truncate_text")
def q_truncate_text(spark, sf_dir):
    """First 400 code points, newlines flattened, stripped."""
    return _docs(spark, sf_dir).select("doc_id", truncate_for_translation("text").alias("truncated"))


@query("scoreable")
def q_scoreable(spark, sf_dir):
    """P2 over mixed lines (blank and NULL ones among them) and conversation turns."""
    d = fx.mixed(spark, sf_dir).select(F.lit("line").alias("kind"), "id", "text")
    c = fx.table(spark, sf_dir, "conversations").select(
        F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return d.unionByName(c).select("kind", "id", is_scoreable("text").alias("scoreable"))


@query("detect_language")
def q_detect_language(spark, sf_dir):
    """F3 + A20 per document."""
    return text_ops.with_language(_docs(spark, sf_dir)).select("doc_id", "en_score", "sn_score", "language")


@query("language_mix")
def q_language_mix(spark, sf_dir):
    """Detected language against the given ``lang`` column."""
    return text_ops.language_mix(_docs(spark, sf_dir), by=["lang"])


@query("lexicon_hits")
def q_lexicon_hits(spark, sf_dir):
    """Tokens of mixed lines joined to the lexicon table."""
    return text_ops.lexicon_hits(fx.mixed(spark, sf_dir))


@query("lexical_floors")
def q_lexical_floors(spark, sf_dir):
    """A19 + F5: per-label max floor over each mixed line's tokens."""
    d = fx.mixed(spark, sf_dir).withColumn("_t", tokens("text"))
    fl = slur_floors(F.col("_t"))
    return d.select("id", *[_r(fl[l]).alias(f"f_{l}") for l in LABELS])


@query("benign_cap")
def q_benign_cap(spark, sf_dir):
    """F4 / F5 on fixture base scores of mixed lines: whitelist cap, else lexical floors."""
    d = fx.mixed(spark, sf_dir).withColumn("_t", tokens("text"))
    adj = shona_adjust(fx.fixture_scores(F.col("id")), F.col("_t"))
    return d.select("id", benign_whitelisted(F.col("_t")).alias("whitelisted"),
                    *[_r(adj[l]).alias(f"s_{l}") for l in LABELS])


@query("sigmoid_flags")
def q_sigmoid_flags(spark, sf_dir):
    """sigmoid of a margin, decision at 0.5."""
    d = _docs(spark, sf_dir)
    probs = {l: sigmoid((fx.fixture_score(l, F.col("doc_id")) - 0.5) * 8.0) for l in LABELS}
    flags = flagged_labels(probs, normalize_thresholds(0.5))
    return d.select("doc_id", *[_r(probs[l]).alias(f"p_{l}") for l in LABELS],
                    F.array_join(flags, ",").alias("flagged"))


# ------------------------------------------------------------ labels & thresholds
@query("category_labels")
def q_category_labels(spark, sf_dir):
    """P4 on every annotated row."""
    a = fx.annotated(spark, sf_dir)
    labs = category_labels(F.col("category"), F.col("severity"), F.col("label") == "toxic")
    return a.select("doc_id", "label", "category", "severity", *[labs[l].alias(l) for l in LABELS])


@query("drop_unscored")
def q_drop_unscored(spark, sf_dir):
    """Rows with no -1 label."""
    return fx.comment_table(spark, sf_dir).filter(scored_row()).select("doc_id", *LABELS)


@query("positive_counts")
def q_positive_counts(spark, sf_dir):
    """P3 on the scored rows: any-positive / no-positive counts, positives per label."""
    t = fx.comment_table(spark, sf_dir).filter(scored_row())
    return t.agg(F.count(F.lit(1)).alias("n"),
                 F.count_if(any_positive()).alias("n_positive"),
                 F.count_if(label_sum() == 0).alias("n_negative"),
                 *[F.sum(l).cast("bigint").alias(f"pos_{l}") for l in LABELS])


@query("flag_labels")
def q_flag_labels(spark, sf_dir):
    """P7 + P10 with the served default thresholds on fixture scores."""
    d = _docs(spark, sf_dir)
    sc = fx.fixture_scores(F.col("doc_id"))
    fl = flagged_labels(sc, resolve_thresholds(), is_scoreable("text"))
    return d.select("doc_id", F.array_join(fl, ",").alias("flagged"), (F.size(fl) > 0).alias("is_toxic"))


@query("flag_uniform")
def q_flag_uniform(spark, sf_dir):
    """A uniform 0.5 threshold (evaluations)."""
    d = _docs(spark, sf_dir)
    fl = flagged_labels(fx.fixture_scores(F.col("doc_id")), normalize_thresholds(0.5))
    return d.select("doc_id", F.array_join(fl, ",").alias("flagged"))


def request_overrides(id_col):
    """A per-row override map derived from the id: toxic varies, insult is
    NULL on every third row, an unknown label is ignored."""
    return F.create_map(
        F.lit("toxic"), (F.pmod(id_col, F.lit(10)) / 10.0).cast("double"),
        F.lit("insult"), F.when(F.pmod(id_col, F.lit(3)) == 0, F.lit(None).cast("double")).otherwise(F.lit(0.45)),
        F.lit("bogus"), F.lit(0.1))


@query("resolve_thresholds")
def q_resolve_thresholds(spark, sf_dir):
    """Request map over per-label setting over defaults."""
    d = _docs(spark, sf_dir)
    thr = resolve_thresholds(request_overrides(F.col("doc_id")), per_label={"obscene": 0.7})
    return d.select("doc_id", *[thr[l].alias(f"t_{l}") for l in LABELS])


@query("request_reject")
def q_request_reject(spark, sf_dir):
    """P5: documents and mixed lines as single requests (language = their lang), mixed lines
    as batch requests (one per document) and conversations (one per conv_id)."""
    cols = ["kind", "id", "n", "valid", "reason"]
    texts = _docs(spark, sf_dir).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text", F.col("lang").alias("language"))
    lines = fx.mixed(spark, sf_dir)
    texts = texts.unionByName(lines.select(F.lit("line").alias("kind"), "id", "text", F.col("lang").alias("language")))
    single = rq.validate_single(texts, "text", "language").withColumn("n", F.length("text").cast("bigint"))
    pasted = rq.validate_batches(lines.withColumn("doc_id", F.floor(F.col("id") / 1000000)), "doc_id", language="en")
    turns = rq.validate_batches(fx.table(spark, sf_dir, "conversations"), "conv_id", language="xx")
    batches = [b.select(F.lit(k).alias("kind"), F.col(c).alias("id"), F.col("n_items").alias("n"), "valid", "reason")
               for b, k, c in ((pasted, "pasted", "doc_id"), (turns, "turns", "conv_id"))]
    return single.select(*cols).unionByName(batches[0]).unionByName(batches[1])


@query("split_lines")
def q_split_lines(spark, sf_dir):
    """Each document as a pasted block, one comment per line."""
    return text_ops.split_lines(_docs(spark, sf_dir))


# ------------------------------------------------------------ scoring
@query("moderate_en")
def q_moderate_en(spark, sf_dir):
    """U4: English scoring of every document with the marker scorer."""
    return moderated_view(moderate(_docs(spark, sf_dir), "text", language="en"), "doc_id")


@query("moderate_sn")
def q_moderate_sn(spark, sf_dir):
    """Shona scoring of mixed lines with zero base scores: whitelist / floors only."""
    m = moderate(fx.mixed(spark, sf_dir), "text", language="sn",
                 sn_scorer=ShonaScorer(ConstantScorer(0.0, name="zero-sn")))
    return moderated_view(m, "id")


@query("score_batch")
def q_score_batch(spark, sf_dir):
    """A pandas model over Arrow batches (mapInPandas), uniform 0.5."""
    scorer = PandasScorer(marker_predictor(), name="pandas-marker", batch_size=16)
    out = score_batch(_docs(spark, sf_dir).select("doc_id", "text"), "text", scorer, 0.5)
    return out.select("doc_id", *[F.col(f"score_{l}").alias(f"s_{l}") for l in LABELS],
                      F.array_join("flagged_labels", ",").alias("flagged"), "is_toxic")


@query("moderate_requests")
def q_moderate_requests(spark, sf_dir):
    """U6 for requests that each name a language (``en``, ``sn``, ``auto`` or none) and thresholds: both
    models in one pass, neither naming all labels (P10), Shona floors and whitelist on top."""
    d = fx.mixed(spark, sf_dir)
    k = fx.digits_of("ask", F.col("id"), 0)
    d = d.withColumns({"ask": F.when(k < 4, "en").when(k < 8, "sn").when(k < 13, "auto"), "limits": request_overrides(F.col("id"))})
    m = moderate(d, "text", language=F.col("ask"), thresholds=F.col("limits"), per_label={"obscene": 0.7},
                 en_scorer=PandasScorer(marker_mapper(), name="model-en", batch_size=16),
                 sn_scorer=ShonaScorer(PandasScorer(marker_mapper(lx.SN_MARKERS), name="model-sn", batch_size=16)))
    return moderated_view(m, "id")


@query("score_throughput")
def q_score_throughput(spark, sf_dir):
    """Counts observed while moderated lines are written once; the rate is theirs over the seconds it took."""
    m = moderate(fx.mixed(spark, sf_dir), "text", language="auto")
    seen, seconds = observed_write(m, scratch_path(spark, "moderated"), {
        "n": F.count(F.lit(1)), "n_toxic": F.count_if(F.col("is_toxic")), "n_sn": F.count_if(F.col("language") == "sn")})
    rate = round(seen["n"] / seconds, 1)
    return spark.createDataFrame([(seen["n"], seen["n_toxic"], seen["n_sn"], rate > 0)], "n long, n_toxic long, n_sn long, has_rate boolean")


# ------------------------------------------------------------ validation & sources
from moderato.operators import sampling as smp  # noqa: E402
from moderato.operators import validate as val  # noqa: E402
from moderato.plans import dataset as ds  # noqa: E402
from moderato.session import scratch_path, staged  # noqa: E402
from moderato.sources import csv as src  # noqa: E402
from moderato.sources import reports as rp  # noqa: E402


def _validation_inputs(spark, sf_dir):
    """The annotated rows as they are, with values that break rules, and with severities that are no numbers."""
    clean = fx.annotated(spark, sf_dir).select(
        "doc_id", "text", "label", "category", F.col("severity").cast("string").alias("severity"), F.col("source").alias("source_lemma"))
    return {"clean": clean, "broken": fx.raw_annotated(spark, sf_dir), "not_numeric": fx.raw_annotated(spark, sf_dir, numeric=False)}


def _union(parts):
    return reduce(DataFrame.unionByName, parts)


@query("validate_rows")
def q_validate_rows(spark, sf_dir):
    """A3-A7, one scan a table."""
    return _union([val.validate_rows(df, order_col="doc_id").withColumn("input", F.lit(name))
                   for name, df in _validation_inputs(spark, sf_dir).items()])


@query("validate_verdict")
def q_validate_verdict(spark, sf_dir):
    """A8 over the checks."""
    return _union([val.validate_verdict(val.validate_rows(df, order_col="doc_id")).withColumn("input", F.lit(name))
                   for name, df in _validation_inputs(spark, sf_dir).items()])


@query("duplicate_text")
def q_duplicate_text(spark, sf_dir):
    """A7 over every document."""
    return val.duplicate_text(_docs(spark, sf_dir), "text", order_col="doc_id")


@query("category_counts")
def q_category_counts(spark, sf_dir):
    """A2: category and label breakdowns."""
    return val.value_counts(fx.annotated(spark, sf_dir), ("category", "label"))


@query("scan_comments")
def q_scan_comments(spark, sf_dir):
    """S1 + S6: the comment table written as CSV to the shared scratch folder
    and scanned back with a declared schema (NULL text -> '')."""
    from moderato.schema import COMMENT_ROW
    path = scratch_path(spark, "scan_comments")
    t = fx.comment_table(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), "comment_text", *LABELS)
    (t.write.mode("overwrite").option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    back = src.scan_comments(spark, path, "csv", COMMENT_ROW)
    return back.select(F.col("id").cast("bigint").alias("doc_id"), "comment_text", *LABELS)


@query("native_rows")
def q_native_rows(spark, sf_dir):
    """Annotated rows as training rows."""
    n = src.native_rows(fx.annotated(spark, sf_dir))
    return n.select("doc_id", *ds.TRAINING_COLS)


@query("custom_sources")
def q_custom_sources(spark, sf_dir):
    """S3 per-file rules over files of every kind: reserved, template, bad severity, kept."""
    return src.custom_rows(fx.filed(spark, sf_dir)).select("doc_id", *LABELS, "source")


@query("custom_discovery")
def q_custom_discovery(spark, sf_dir):
    """S3 over CSV files of every kind, written first: reserved, template, bad severities, columns in
    another order, columns missing.  One row per file with its verdict."""
    rows = fx.filed(spark, sf_dir).withColumn("file", F.substring_index("_file", "/data/", -1))
    path = scratch_path(spark, "custom")
    odd, bare = F.col("source") == "src4", F.col("source") == "src5"
    kinds = {"plain": (~odd & ~bare, ["text", "label", "category", "severity", "source"]),
             "turned": (odd, ["severity", "category", "label", "text"]), "bare": (bare, ["text", "label"])}
    for kind, (which, cols) in kinds.items():
        part = rows.filter(which).withColumn("text", F.translate("text", "\r", " ")).select("file", *cols)
        (part.repartition("file").write.partitionBy("file").option("header", True).option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{path}/{kind}"))
    found = src.Discovery(spark, [f"{path}/{k}" for k in kinds],
                          lambda p: F.replace(F.url_decode(F.regexp_extract(p, "file=([^/]+)/", 1)), F.lit("%2F"), F.lit("/")))
    return found.verdicts.select("file", F.array_join("header", ",").alias("header"), "n_rows", "bad_severities", "verdict")


# ------------------------------------------------------------ sampling & splits
@query("shuffled")
def q_shuffled(spark, sf_dir):
    """Every document's position in the seeded order."""
    return smp.shuffled(_docs(spark, sf_dir).select("doc_id"), "doc_id")


@query("sample_n")
def q_sample_n(spark, sf_dir):
    """500 rows (the reference's default benchmark sample) of the scored lines."""
    t = fx.drawn(spark, sf_dir).filter(scored_row())
    return smp.sample_n(t.select("id", *LABELS), 500, "id")


@query("stratified_sample")
def q_stratified_sample(spark, sf_dir):
    """M1 with the reference's default train target (3000) on scored lines."""
    t = fx.drawn(spark, sf_dir).filter(scored_row()).select("id", *LABELS)
    return smp.stratified_sample(t, 3000, "id")


@query("split_assign")
def q_split_assign(spark, sf_dir):
    """M2: exact 80/10/10 split of the annotated rows."""
    return smp.split_assign(fx.annotated(spark, sf_dir).select("doc_id"), "doc_id")


@query("cv_folds")
def q_cv_folds(spark, sf_dir):
    """Stratified 3 folds per label of the scored rows."""
    t = fx.comment_table(spark, sf_dir).filter(scored_row()).select("doc_id", *LABELS)
    return smp.cv_folds(t, "doc_id")


@query("silver_split")
def q_silver_split(spark, sf_dir):
    """M3 for the three given splits at once: (test: P1) -> M1 -> P6 -> identity translator in batches of 16."""
    out = ds.silver_splits(fx.drawn(spark, sf_dir), "id", "given")
    return out.select("id", F.col("given").alias("split"), "pos", *ds.TRAINING_COLS)


def _native_parts(spark, sf_dir):
    """Native, clean conversational and custom rows, each split 80/10/10 (custom files pooled first)."""
    conv = fx.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return ds.split_parts([ds.keyed(src.native_rows(fx.annotated(spark, sf_dir)), "native", "doc_id"),
                           ds.keyed(ds.clean_rows(conv), "clean", "id"),
                           ds.keyed(src.custom_rows(fx.filed(spark, sf_dir)), "custom", "doc_id")])


def _silver_part(spark, sf_dir):
    out = ds.silver_splits(fx.drawn(spark, sf_dir), "id", "given", {k: v for k, v in ds.SILVER_TARGETS.items() if k != "test"})
    return ds.keyed(out.withColumn("split", F.col("given")), "silver", "id")


def _merged(spark, sf_dir):
    native = _native_parts(spark, sf_dir).filter("split <> 'test'")
    return ds.merge_sources([_silver_part(spark, sf_dir), native])


@query("merge_sources")
def q_merge_sources(spark, sf_dir):
    """Silver + native + clean + custom rows of train and validation, in their seeded order, no dedup."""
    return _merged(spark, sf_dir)


@query("native_test")
def q_native_test(spark, sf_dir):
    """Native + clean + custom test rows; the silver test draw isn't even made."""
    return ds.merge_sources([_native_parts(spark, sf_dir).filter("split = 'test'").withColumn("split", F.lit("native_test"))])


@query("source_counts")
def q_source_counts(spark, sf_dir):
    """A1: rows and positives per (split, source) with rollup totals, the native test among the splits."""
    native = _native_parts(spark, sf_dir).withColumn("split", F.when(F.col("split") == "test", "native_test").otherwise(F.col("split")))
    cols = ["split", "source", *LABELS]
    m = _silver_part(spark, sf_dir).select(*cols).unionByName(native.select(*cols))
    return m.rollup("split", "source").agg(F.count(F.lit(1)).alias("n"),
                                           *[F.sum(l).cast("bigint").alias(l) for l in LABELS])


# ------------------------------------------------------------ evaluation
from moderato.functions.labels import label_array  # noqa: E402
from moderato.operators import evaluate as ev  # noqa: E402

# Column names (not Columns: no session exists at import time).
_TRUTH = {l: l for l in LABELS}
_PA = {l: f"pa_{l}" for l in LABELS}
_PB = {l: f"pb_{l}" for l in LABELS}


def eval_frame(spark, sf_dir):
    """Scored comments with truth (P4 labels), model A probabilities (the
    md5 fixture) and model B probabilities (the marker scorer)."""
    t = fx.comment_table(spark, sf_dir).filter(scored_row())
    a = fx.fixture_scores(F.col("doc_id"))
    b = MarkerScorer().columns(F.col("comment_text"), None)
    return t.select("doc_id", "comment_text", *LABELS, *[a[l].alias(f"pa_{l}") for l in LABELS],
                    *[b[l].alias(f"pb_{l}") for l in LABELS])


def _round_all(df, cols):
    return df.withColumns({c: _r(F.col(c)) for c in cols})


@query("confusion")
def q_confusion(spark, sf_dir):
    """TP/FP/FN/TN per label, model A at 0.5."""
    return ev.confusion(eval_frame(spark, sf_dir), _TRUTH, ev.threshold_preds(_PA))


@query("label_metrics")
def q_label_metrics(spark, sf_dir):
    """J5 + A10: precision, recall, F1 per label."""
    m = ev.label_metrics(ev.confusion(eval_frame(spark, sf_dir), _TRUTH, ev.threshold_preds(_PA)))
    return _round_all(m.select("label", "support", "precision", "recall", "f1"), ["precision", "recall", "f1"])


_OVERALL = ["macro_f1", "macro_f1_tested", "micro_f1", "hamming_loss", "subset_accuracy"]


@query("macro_micro")
def q_macro_micro(spark, sf_dir):
    """A11 (both variants), A12, A15, A16."""
    return _round_all(ev.overall_metrics(eval_frame(spark, sf_dir), _TRUTH, ev.threshold_preds(_PA)), _OVERALL)


@query("roc_auc")
def q_roc_auc(spark, sf_dir):
    """A13 per label (NULL when one-class)."""
    r = ev.roc_auc(eval_frame(spark, sf_dir), _TRUTH, _PA)
    return r.withColumn("roc_auc", _r(F.col("roc_auc")))


@query("roc_auc_overall")
def q_roc_auc_overall(spark, sf_dir):
    """Macro (NULL if any label is one-class) and micro AUC."""
    r = ev.roc_auc_overall(eval_frame(spark, sf_dir), _TRUTH, _PA)
    return _round_all(r, ["macro_roc_auc", "micro_roc_auc"])


def _drawn_eval(spark, sf_dir):
    """Scored lines with truth and model A probabilities."""
    t = fx.drawn(spark, sf_dir).filter(scored_row())
    a = fx.fixture_scores(F.col("id"))
    return t.select("id", *LABELS, *[a[l].alias(f"pa_{l}") for l in LABELS])


@query("benchmark_eval")
def q_benchmark_eval(spark, sf_dir):
    """U8: P1 -> 500-row seeded sample -> model A -> uniform 0.5 -> A9-A16."""
    s = staged(smp.sample_n(_drawn_eval(spark, sf_dir), 500, "id"), "benchmark-sample")
    om = ev.overall_metrics(s, _TRUTH, ev.threshold_preds(_PA)).select(
        F.col("n").alias("n_test"), "macro_f1", "micro_f1", "hamming_loss", "subset_accuracy")
    auc = ev.roc_auc_overall(s, _TRUTH, _PA)
    one = F.lit(1).alias("_one")
    out = om.select("*", one).join(auc.select("*", one), "_one").drop("_one")
    return _round_all(out, ["macro_f1", "micro_f1", "hamming_loss", "subset_accuracy",
                            "macro_roc_auc", "micro_roc_auc"])


def golden_frame(spark, sf_dir):
    """Annotated rows as golden examples: expected = P4 labels, predicted =
    marker scorer at 0.5 (no blank short-circuit, as in the golden run),
    known limitation = the two categories that map to no extra label."""
    a = fx.annotated(spark, sf_dir)
    labs = category_labels(F.col("category"), F.col("severity"), F.col("label") == "toxic")
    b = MarkerScorer().columns(F.col("text"), None)
    known = F.col("category").isin("benign_conversational", "literal_or_metalinguistic")
    return a.select("doc_id", label_array(labs).alias("expected"),
                    label_array(ev.threshold_preds(b)).alias("predicted"), known.alias("known_limitation"),
                    F.when(known, F.concat(F.lit("documented for "), F.col("category"))).alias("limitation_note"))


def golden_lines(spark, sf_dir):
    """Drawn lines as golden examples with their mixed texts: markers give labels in excess, and three
    in sixteen are known limitations, some of which pass."""
    d, m = fx.drawn(spark, sf_dir).filter(scored_row()), fx.mixed(spark, sf_dir).select("id", "text")
    b = MarkerScorer().columns(F.col("text"), None)
    known = fx.digits_of("drawn", F.col("id"), 9) < 3
    return d.join(m, "id").select(
        "id", label_array({l: F.col(l) for l in LABELS}).alias("expected"), label_array(ev.threshold_preds(b)).alias("predicted"),
        known.alias("known_limitation"), F.when(known, F.concat(F.lit("documented as "), F.col("id").cast("string"))).alias("limitation_note"))


@query("golden_mismatches")
def q_golden_mismatches(spark, sf_dir):
    """U9 by example: labels missing and in excess, and known limitations that now pass."""
    m = ev.golden_mismatches(golden_lines(spark, sf_dir), "id")
    return m.select("id", "slice", "kind", "label", F.array_join("expected", ",").alias("expected"),
                    F.array_join("predicted", ",").alias("predicted"), "limitation_note")


@query("truth_join")
def q_truth_join(spark, sf_dir):
    """Truth (some ids absent, some twice) against predictions (others absent), joined; coverage, and
    A9 over the matched ids."""
    a = fx.annotated(spark, sf_dir)
    labs = category_labels(F.col("category"), F.col("severity"), F.col("label") == "toxic")
    truth = a.filter(F.col("doc_id") % 7 != 3).select("doc_id", *[labs[l].alias(l) for l in LABELS])
    truth = truth.unionByName(truth.filter(F.col("doc_id") % 11 == 5))
    sc = fx.fixture_scores(F.col("doc_id"))
    pred = _docs(spark, sf_dir).filter(F.col("doc_id") % 5 != 2).select("doc_id", *[sc[l].alias(f"pa_{l}") for l in LABELS])
    pred = pred.unionByName(pred.filter(F.col("doc_id") % 13 == 4))
    j = ev.align(truth, pred, "doc_id")
    cov = ev.coverage(j).select(F.lit("coverage").alias("part"), F.col("status").alias("name"), F.lit(None).cast("string").alias("label"), "n")
    conf = ev.confusion(j.filter("status = 'matched'"), _TRUTH, ev.threshold_preds(_PA))
    conf = conf.select(F.lit("confusion").alias("part"), "label", F.expr("stack(4, 'tp', tp, 'fp', fp, 'fn', fn, 'tn', tn) as (name, n)"))
    return cov.unionByName(conf)


#: Slices that a full report has; no table here gives the last two.
SLICES = ["mt_silver", "native", "golden", "native_social", "custom_reviewed"]


@query("slice_report")
def q_slice_report(spark, sf_dir):
    """A23 + S8: every expected slice, absent ones as skipped; the golden slice counts all its
    examples and scores those that gate."""
    d = _drawn_eval(spark, sf_dir)
    a = eval_frame(spark, sf_dir).select(F.col("doc_id").alias("id"), *LABELS, *[f"pa_{l}" for l in LABELS])
    known = fx.digits_of("drawn", F.col("id"), 9) < 3
    rows = _union([d.withColumns({"slice": F.when(fx.digits_of("drawn", F.col("id"), 8) == 9, "golden").otherwise("mt_silver"), "_gates": ~known}),
                   a.withColumns({"slice": F.lit("native"), "_gates": F.lit(True)})])
    r = ev.slice_report(rows, _TRUTH, ev.threshold_preds(_PA), SLICES, scored=(F.col("slice") != "golden") | F.col("_gates"))
    return _round_all(r, ["macro_f1", "micro_f1", "hamming_loss", "subset_accuracy"])


@query("report_compare")
def q_report_compare(spark, sf_dir):
    """S7 + S5 + J6: model B's report, without one label, written as JSON to the shared folder, read
    back with its declared schema and compared with model A."""
    e = eval_frame(spark, sf_dir)
    per = ev.label_metrics(ev.confusion(e, _TRUTH, ev.threshold_preds(_PB))).filter("label <> 'threat'")
    prior = rp.build_report(per, ev.overall_metrics(e, _TRUTH, ev.threshold_preds(_PB)).withColumnRenamed("n", "n_test"))
    path = scratch_path(spark, "prior-report")
    rp.write_report(prior, path)
    back = rp.read_report(spark, path)
    new = rp.build_report(ev.label_metrics(ev.confusion(e, _TRUTH, ev.threshold_preds(_PA))),
                          ev.overall_metrics(e, _TRUTH, ev.threshold_preds(_PA)).withColumnRenamed("n", "n_test"))
    a, b = rp.report_long(new), rp.report_long(back).withColumnRenamed("value", "baseline")
    out = a.join(b, ["label", "metric"], "left").filter(F.col("value").isNotNull())
    return out.select("label", "metric", _r(F.col("value")).alias("value"), _r(F.col("baseline")).alias("baseline"),
                      _r(F.col("value") - F.col("baseline")).alias("delta"))


@query("golden_eval")
def q_golden_eval(spark, sf_dir):
    """U9 + P11 + A17: exact-match rate and tested macro F1 per slice."""
    g = ev.golden_slices(golden_frame(spark, sf_dir))
    return _round_all(g, ["exact_match_rate", "macro_f1"])


@query("model_compare")
def q_model_compare(spark, sf_dir):
    """Per-label F1 of model A against model B (the baseline)."""
    e = eval_frame(spark, sf_dir)
    a = ev.label_metrics(ev.confusion(e, _TRUTH, ev.threshold_preds(_PA)))
    b = ev.label_metrics(ev.confusion(e, _TRUTH, ev.threshold_preds(_PB)))
    return _round_all(ev.model_compare(a, b), ["f1", "baseline_f1", "delta"])


@query("eval_gate")
def q_eval_gate(spark, sf_dir):
    """Golden gates plus 'new beats baseline' on the benchmark."""
    e = eval_frame(spark, sf_dir)
    new = ev.overall_metrics(e, _TRUTH, ev.threshold_preds(_PA))
    base = ev.overall_metrics(e, _TRUTH, ev.threshold_preds(_PB))
    g = ev.eval_gate(ev.golden_slices(golden_frame(spark, sf_dir)), new, base)
    return _round_all(g, ["exact_match_rate", "golden_macro_f1", "new_macro_f1", "baseline_macro_f1"])


@query("slice_metrics")
def q_slice_metrics(spark, sf_dir):
    """The same metrics per evidence slice (here: document language)."""
    e = eval_frame(spark, sf_dir).join(fx.table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("slice")),
                                       "doc_id")
    om = ev.overall_metrics(e, _TRUTH, ev.threshold_preds(_PA), by=["slice"])
    return _round_all(om.select("slice", F.col("n").alias("n_examples"),
                                F.col("macro_f1_tested").alias("macro_f1"), "micro_f1"), ["macro_f1", "micro_f1"])


@query("class_weights")
def q_class_weights(spark, sf_dir):
    """Balanced class weights n / (2 n_class) per label."""
    t = fx.comment_table(spark, sf_dir).filter(scored_row())
    stack = "stack({}, {}) as (label, y)".format(len(LABELS), ", ".join(f"'{l}', `{l}`" for l in LABELS))
    w = t.select(F.expr(stack)).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == 1).alias("n_pos"),
        F.count_if(F.col("y") == 0).alias("n_neg"))
    return w.select("label", "n", "n_pos", "n_neg",
                    _r(F.when(F.col("n_pos") > 0, F.col("n") / (2.0 * F.col("n_pos")))).alias("w_pos"),
                    _r(F.when(F.col("n_neg") > 0, F.col("n") / (2.0 * F.col("n_neg")))).alias("w_neg"))


# ------------------------------------------------------------ features
from moderato.operators import features as fe  # noqa: E402


@query("vocab")
def q_vocab(spark, sf_dir):
    """V1 + A24 + W3: the 19,998 most frequent cleaned words with ids
    (ties: first appearance in doc_id order)."""
    return fe.vocabulary(_docs(spark, sf_dir), order_col="doc_id")


@query("encoded")
def q_encoded(spark, sf_dir):
    """V2: every document as 150 word ids (OOV 1, zero padding)."""
    d = _docs(spark, sf_dir)
    seq = fe.encode(d, fe.vocabulary(d, order_col="doc_id"), "doc_id")
    return seq.select("doc_id", F.array_join(F.transform("sequence", lambda x: x.cast("string")), ",").alias("sequence"))


@query("doc_freq")
def q_doc_freq(spark, sf_dir):
    """Document frequency with the min_df cut, both blocks."""
    d = _docs(spark, sf_dir).select("doc_id", "text")
    parts = []
    for a in ("word", "char"):
        parts.append(fe.document_frequency(d, "text", a).select(F.lit(a).alias("block"), "term", "df"))
    return parts[0].unionByName(parts[1])


def _tfidf(spark, sf_dir, analyzer):
    _, w = fe.fit_transform_tfidf(_docs(spark, sf_dir), "doc_id", "text", analyzer)
    return w.withColumn("weight", _r(F.col("weight")))


@query("tfidf_word")
def q_tfidf_word(spark, sf_dir):
    """V3: word 1-2-gram TF-IDF (min_df 2, sublinear tf), long form."""
    return _tfidf(spark, sf_dir, "word")


@query("tfidf_char")
def q_tfidf_char(spark, sf_dir):
    """V4: char_wb 3-5-gram TF-IDF (min_df 3, sublinear tf), long form."""
    return _tfidf(spark, sf_dir, "char")


@query("tfidf_validation")
def q_tfidf_validation(spark, sf_dir):
    """V5 on unseen text: both blocks fitted on the train part of the documents and stored; the
    stored idf weighs the validation part, each block normalised on its own."""
    d = _docs(spark, sf_dir)
    path, parts = scratch_path(spark, "tfidf"), []
    for a in ("word", "char"):
        fe.fit_tfidf(d.filter(F.col("doc_id") % 10 < 8), "doc_id", "text", a).save(f"{path}/{a}", version=1)
        parts.append(fe.TfidfModel.load(spark, f"{path}/{a}", 1).transform(d.filter(F.col("doc_id") % 10 >= 8), "doc_id", "text"))
    return fe.union_features(*parts, "doc_id").withColumn("weight", _r(F.col("weight")))


@query("tfidf_union")
def q_tfidf_union(spark, sf_dir):
    """V5: the union vocabulary with dense feature indices and idf."""
    d = _docs(spark, sf_dir)
    models = [fe.fit_tfidf(d, "doc_id", "text", a) for a in ("word", "char")]
    return fe.feature_index(models).withColumn("idf", _r(F.col("idf")))


# ------------------------------------------------------------ presentation & streaming
from moderato.functions import present as pr  # noqa: E402


@query("ranked_scores")
def q_ranked_scores(spark, sf_dir):
    """O1: label/percent pairs high to low (fixture scores)."""
    d = _docs(spark, sf_dir)
    r = pr.ranked_scores(fx.fixture_scores(F.col("doc_id")))
    s = F.array_join(F.transform(r, lambda x: F.concat(x["label"], F.lit(":"), x["pct"].cast("string"))), ",")
    return d.select("doc_id", s.alias("ranked"))


@query("verdict_text")
def q_verdict_text(spark, sf_dir):
    """verdict line and tags per document (auto language, marker scorers)."""
    m = moderate(_docs(spark, sf_dir), "text", language="auto")
    return m.select("doc_id", pr.verdict_line(F.col("language"), F.col("is_toxic"), F.col("flagged_labels")).alias("verdict"),
                    pr.label_tags(F.col("flagged_labels")).alias("tags"))


@query("moderate_stream")
def q_moderate_stream(spark, sf_dir):
    """Documents read as a file stream, moderated by the batch function,
    drained with availableNow; equals ``moderate_auto``."""
    from moderato.streaming import moderate_stream as ms
    # The braces let the table be one file or a folder of files.
    stream = ms.read_stream(spark, f"{sf_dir}/{{documents.parquet}}")
    # The fixture stream is one file (one task per micro-batch); spread it
    # over the cores.  A partitioned source (e.g. Kafka) would not need this.
    stream = stream.select("doc_id", "text").repartition(spark.sparkContext.defaultParallelism)
    out = ms.run_to_table(spark, ms.moderate_stream(stream, "text").drop("thresholds_used"))
    return moderated_view(spark.read.parquet(out), "doc_id")


# ------------------------------------------------------------ training
def _training_rows(spark, sf_dir):
    """Drawn lines of the train and validation splits, scored ones only."""
    return fx.drawn(spark, sf_dir).filter(scored_row()).withColumnRenamed("comment_text", "text")


@query("train_calibrated")
def q_train_calibrated(spark, sf_dir):
    """T1 + T4: calibrated per-label models of the train split of drawn lines,
    metrics on its validation split (long form)."""
    from moderato.operators.train import train_calibrated, validation_metrics
    rows = _training_rows(spark, sf_dir)
    model = train_calibrated(rows.filter("given = 'train'"), id_col="id")
    m = validation_metrics(model, rows.filter("given = 'validation'"), id_col="id")
    return m.withColumn("value", _r(F.col("value")))


@query("moderate_sn_trained")
def q_moderate_sn_trained(spark, sf_dir):
    """U5 with a trained scorer: the calibrated model, stored and loaded as a bundle (T5), behind the
    whitelist and the floors, over mixed lines."""
    from moderato.operators.score import CalibratedScorer
    from moderato.operators.train import CalibratedModel, train_calibrated
    path = scratch_path(spark, "bundle")
    train_calibrated(_training_rows(spark, sf_dir).filter("given = 'train'"), id_col="id").save(path)
    scorer = ShonaScorer(CalibratedScorer(CalibratedModel.load(spark, path)))
    return moderated_view(moderate(fx.mixed(spark, sf_dir), "text", language="sn", sn_scorer=scorer), "id")
