"""Every lexical, request, validation and source rule is reached by the fixture rows."""

from pyspark.sql import functions as F

from moderato.plans.catalog import QUERIES
from moderato.schema import LABELS

SF = "/root/testdata/sf0.01"


def rows(spark, name):
    return QUERIES[name](spark, SF).collect()


def test_lexical_rules(spark):
    floors = rows(spark, "lexical_floors")
    assert all(any(r[f"f_{l}"] > 0 for r in floors) for l in LABELS if l != "identity_hate")
    cap = rows(spark, "benign_cap")
    assert any(r.whitelisted for r in cap) and all(r[f"s_{l}"] <= 0.02 for r in cap if r.whitelisted for l in LABELS)
    sn = rows(spark, "moderate_sn")
    assert any(r.is_toxic for r in sn) and any(not r.is_toxic for r in sn)
    kinds = {r.kind for r in rows(spark, "lexicon_hits")}
    assert kinds == {"en_word", "sn_word", "benign", "known_toxic", "floor"}
    assert {r.scoreable for r in rows(spark, "scoreable")} == {True, False}


def test_request_rules(spark):
    reasons = {r.reason for r in rows(spark, "request_reject")}
    assert reasons == {None, "missing_text", "empty_text", "text_too_long", "bad_language", "batch_too_large"}


def test_validation_rules(spark):
    checks = {(r.input, r.rule) for r in rows(spark, "validate_rows")}
    broken = {rule for i, rule in checks if i == "broken"}
    assert broken >= {"null:text", "null:label", "null:category", "null:source_lemma", "invalid_label", "invalid_category", "severity_out_of_range",
                      "nontoxic_with_severity", "toxic_severity_zero", "duplicate_text", "invalid_label_value", "invalid_category_value"}
    assert ("not_numeric", "severity_non_integer") in checks and ("not_numeric", "severity_out_of_range") not in checks
    assert {r.input: r.passed for r in rows(spark, "validate_verdict")} == {"clean": True, "broken": False, "not_numeric": False}


def test_source_rules(spark):
    sources = {r.source for r in rows(spark, "custom_sources")}
    assert "custom_full" not in sources and "custom_src2 en" not in sources
    assert any("src3" in s for s in sources) and "custom_custom_shona_template" in sources


def test_caps_bind(spark):
    silver = QUERIES["silver_split"](spark, SF).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("toxic") == -1, 1).otherwise(0)).alias("unscored")).collect()
    assert {r.split: r.n for r in silver} == {"train": 3000, "validation": 500, "test": 500}
    assert len(rows(spark, "sample_n")) == 500 and len(rows(spark, "stratified_sample")) == 3000
    kinds = {r.kind for r in rows(spark, "golden_mismatches")}
    assert kinds == {"missing", "extra", "now_passes"}
