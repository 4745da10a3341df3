"""JSON report sink and prior-report scan (S5, S7) and model comparison."""

import json
import os

from moderato.operators import evaluate as ev
from moderato.schema import LABELS
from moderato.sources import reports as rp


def _frames(spark):
    rows = [(i, *[(i + j) % 3 == 0 for j in range(6)], *[((i * 7 + j) % 10) / 10 for j in range(6)]) for i in range(60)]
    schema = "id int, " + ", ".join(f"{l} int" for l in LABELS) + ", " + ", ".join(f"p_{l} double" for l in LABELS)
    rows = [(r[0], *[int(x) for x in r[1:7]], *r[7:]) for r in rows]
    df = spark.createDataFrame(rows, schema)
    truth, prob = {l: l for l in LABELS}, {l: f"p_{l}" for l in LABELS}
    per = ev.label_metrics(ev.confusion(df, truth, ev.threshold_preds(prob))).join(
        ev.roc_auc(df, truth, prob).select("label", "roc_auc"), "label")
    overall = ev.overall_metrics(df, truth, ev.threshold_preds(prob)).withColumnRenamed("n", "n_test")
    return per, overall


def test_report_roundtrip(spark, tmp_dir):
    per, overall = _frames(spark)
    path = os.path.join(tmp_dir, "report")
    rp.write_report(rp.build_report(per, overall), path)
    files = [f for f in os.listdir(path) if f.endswith(".json")]
    doc = json.loads(open(os.path.join(path, files[0])).read())
    assert set(doc["per_label"]) == set(LABELS) and "macro_f1" in doc["overall"]
    back = rp.read_report(spark, path)
    f1 = {r.label: r.f1 for r in rp.report_label_metrics(back).collect()}
    want = {r.label: r.f1 for r in per.collect()}
    assert f1 == want
    long = {(r.label, r.metric): r.value for r in rp.report_long(back).collect()}
    assert long[("overall", "n_test")] == 60.0


def test_compare_against_missing_and_present_baseline(spark, tmp_dir):
    per, overall = _frames(spark)
    assert rp.read_report(spark, os.path.join(tmp_dir, "nope")) is None
    none = ev.model_compare(per, None).collect()
    assert all(r.baseline_f1 is None and r.delta is None for r in none)
    path = os.path.join(tmp_dir, "base")
    rp.write_report(rp.build_report(per, overall), path)
    cmp_ = ev.model_compare(per, rp.report_label_metrics(rp.read_report(spark, path))).collect()
    assert all(abs(r.delta) < 1e-12 for r in cmp_)
