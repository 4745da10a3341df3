"""Moderation with the marker scorers (the reference's API tests, as frames)."""

from pyspark.sql import functions as F

from moderato.functions.present import batch_verdict, label_tags, ranked_scores, verdict_line
from moderato.operators import requests as rq
from moderato.operators.score import (ConstantScorer, MarkerScorer, PandasScorer, ShonaScorer,
                                      batch_summary, marker_mapper, marker_predictor, moderate, observed_write)
from moderato.schema import LABELS


def _frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")


def _rows(df):
    return {r.id: r for r in df.collect()}


def test_toxic_and_clean(spark):
    m = _rows(moderate(_frame(spark, ["You stupid idiot, I could kill you", "The lecture on rivers was useful", "hello"]), "text"))
    assert m[0].is_toxic and "toxic" in m[0].flagged_labels and m[0].language == "en"
    assert not m[1].is_toxic and m[1].flagged_labels == []
    assert m[2].language == "en"
    assert set(m[0].thresholds_used) == set(LABELS)


def test_language_of_each_row(spark):
    df = spark.createDataFrame([(1, "iwe benzi shamwari", "auto"), (2, "a quiet evening", "auto"), (3, "a quiet evening", None),
                                (4, "shamwari", "sn"), (5, None, None)], "id int, text string, lang string")
    kinds = [dict(), dict(en_scorer=PandasScorer(marker_predictor(), "marker-en"))]
    out = [_rows(moderate(df, "text", language=F.col("lang"), **k)) for k in kinds]
    for m in out:
        assert {i: m[i].language for i in m} == {1: "sn", 2: "en", 3: "en", 4: "sn", 5: "en"}


def test_blank_never_flags_even_at_zero(spark):
    m = _rows(moderate(_frame(spark, ["", "   ", None, "idiot"]), "text", global_threshold=0.0))
    for i in (0, 1, 2):
        assert m[i].flagged_labels == [] and not m[i].is_toxic
        assert all(m[i][f"score_{l}"] == 0.0 for l in LABELS)
    assert m[3].is_toxic and len(m[3].flagged_labels) == 6


def test_threshold_above_one_suppresses_and_inclusive(spark):
    m = _rows(moderate(_frame(spark, ["idiot", "idiot"]), "text", thresholds={"toxic": 1.01}))
    assert not m[0].is_toxic
    m = _rows(moderate(_frame(spark, ["idiot"]), "text", thresholds={"toxic": 0.9}))
    assert m[0].flagged_labels == ["toxic"]


def test_per_row_thresholds_and_resolution(spark):
    df = spark.createDataFrame([(0, "idiot", {"toxic": 0.95}), (1, "idiot", {"bogus": 0.1}), (2, "idiot", None)],
                               "id int, text string, thr map<string,double>")
    m = _rows(moderate(df, "text", thresholds=F.col("thr"), per_label={"obscene": 0.7}))
    assert not m[0].is_toxic and m[1].is_toxic and m[2].is_toxic
    assert m[1].thresholds_used["obscene"] == 0.7 and m[1].thresholds_used["threat"] == 0.35


def test_auto_routes_shona(spark):
    texts = ["Ndichakuuraya iwe benzi.", "Mhoro shamwari, makadii?", "you are an idiot"]
    m = _rows(moderate(_frame(spark, texts), "text", language="auto"))
    assert m[0].language == "sn" and m[0].is_toxic and "threat" in m[0].flagged_labels
    assert m[1].language == "sn" and not m[1].is_toxic and m[1].score_toxic <= 0.02
    assert m[2].language == "en" and m[2].is_toxic


def test_greeting_with_slur_not_whitelisted(spark):
    m = _rows(moderate(_frame(spark, ["Mhoro benzi", "mhoro shamwari"]), "text", language="sn",
                       sn_scorer=ShonaScorer(ConstantScorer(0.3))))
    assert m[0].is_toxic and m[0].score_insult == 0.85
    assert not m[1].is_toxic and m[1].score_toxic == 0.02


def test_pandas_model_equals_expression_scorer(spark):
    texts = ["kill it", "fine", "", "I HATE this", None]
    a = _rows(moderate(_frame(spark, texts), "text", en_scorer=MarkerScorer()))
    b = _rows(moderate(_frame(spark, texts), "text",
                       en_scorer=PandasScorer(marker_predictor(), batch_size=2)))
    for i in range(len(texts)):
        assert a[i].flagged_labels == b[i].flagged_labels
        assert all(abs(a[i][f"score_{l}"] - b[i][f"score_{l}"]) < 1e-12 for l in LABELS)


def test_batch_summary_and_order(spark):
    df = spark.createDataFrame([(1, "kill"), (1, "hi"), (2, "hate"), (2, "idiot"), (2, "ok")], "b int, text string")
    s = {r.b: (r.total, r.flagged_count) for r in batch_summary(moderate(df, "text"), ["b"]).collect()}
    assert s == {1: (2, 1), 2: (3, 2)}


def test_request_validation(spark):
    df = spark.createDataFrame([("", "en"), ("a" * 5001, "en"), ("hello", "fr"), ("   ", "en"), ("a" * 5000, "auto")],
                               "text string, language string")
    got = [r.reason for r in rq.validate_single(df).collect()]
    assert got == ["empty_text", "text_too_long", "bad_language", None, None]
    b = spark.createDataFrame([(1, "x")] * 101 + [(2, "y")], "b int, t string")
    v = {r.b: r.reason for r in rq.validate_batches(b, "b").collect()}
    assert v == {1: "batch_too_large", 2: None}


def test_presentation(spark):
    df = spark.createDataFrame([(0.2, 0.9, 0.9, 0.0, 1.2, 0.005)], ", ".join(f"{l} double" for l in LABELS))
    r = df.select(ranked_scores({l: F.col(l) for l in LABELS}).alias("r")).first().r
    assert [x.label for x in r] == ["insult", "severe_toxic", "obscene", "toxic", "identity_hate", "threat"]
    assert r[0].pct == 100 and r[4].pct == 1
    v = spark.createDataFrame([("sn", True, ["toxic", "severe_toxic"]), ("en", False, [])],
                              "language string, t boolean, f array<string>")
    out = v.select(verdict_line(F.col("language"), F.col("t"), F.col("f")).alias("v"),
                   label_tags(F.col("f")).alias("g")).collect()
    assert out[0].v == "[SN] Flagged: toxic, severe_toxic" and out[0].g == "toxic severe toxic"
    assert out[1].v == "[EN] No toxicity detected" and out[1].g == "none"
    assert spark.range(1).select(batch_verdict(F.lit(2), F.lit(5)).alias("x")).first().x == \
        "Batch Result: 2 of 5 comments flagged"


def test_both_models_in_one_pass(spark):
    """Rows of both languages, blank ones and other columns of any kind: one scan, one pass, models
    that leave labels out (P10), thresholds per row."""
    rows = [(0, "you idiot", "en", {"toxic": 0.95}), (1, "ndichakuuraya", "sn", None), (2, "", "sn", {"toxic": 0.0}), (3, None, None, {"insult": 0.0}),
            (4, "iwe benzi shamwari", "auto", {}), (5, "mhoro shamwari", "sn", None), (6, "you idiot", None, {"bogus": 0.0})]
    df = spark.createDataFrame(rows, "id int, text string, lang string, limits map<string,double>")
    df = df.withColumns({"score_toxic": F.lit("mine"), "nested": F.array(F.struct(F.col("id").alias("a")))})
    m = moderate(df.drop("score_toxic"), "text", language=F.col("lang"), thresholds=F.col("limits"),
                 en_scorer=PandasScorer(marker_mapper(), "e", batch_size=2),
                 sn_scorer=ShonaScorer(PandasScorer(marker_mapper(["uraya"]), "s", batch_size=2)))
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow ") == 1
    r = _rows(m)
    assert r[0].score_toxic == 0.9 and r[0].score_threat == 0.0 and not r[0].is_toxic and r[6].is_toxic
    assert r[1].score_threat == 0.9 and r[1].score_toxic == 0.95 and r[1].model == "s"
    assert not r[2].is_toxic and r[3].flagged_labels == [] and r[3].language == "en"
    assert r[4].language == "sn" and r[4].score_insult == 0.85 and r[5].score_toxic <= 0.02
    assert r[4].nested == [(4,)] and r[0].limits == {"toxic": 0.95}


def test_observed_write(spark, tmp_dir):
    m = moderate(_frame(spark, ["kill it", "fine", "", "I HATE this", None]), "text")
    seen, seconds = observed_write(m, tmp_dir + "/out", {"n": F.count(F.lit(1)), "bad": F.count_if(F.col("is_toxic"))})
    assert seen == {"n": 5, "bad": 2} and seconds > 0 and spark.read.parquet(tmp_dir + "/out").count() == 5
