"""Validator (A2-A8), CSV sources (S1-S3, S6, S8) with real files."""

import os

import pytest
from pyspark.sql import functions as F

from moderato.operators.validate import validate_rows, validate_verdict
from moderato.schema import LABELS, NATIVE_ROW
from moderato.sources import csv as src

HEADER = "text,label,category,severity,source_lemma\n"


def _write(path, body, header=HEADER):
    with open(path, "w") as f:
        f.write(header + body)


def _checks(df):
    return {r.rule: r for r in validate_rows(df).collect() if not r.rule.endswith("_value")}


def test_valid_template_passes(spark, tmp_dir):
    p = os.path.join(tmp_dir, "t.csv")
    _write(p, 'Ndichakurova.,toxic,threat,3,kurova\n"Mhoro, shamwari",non-toxic,benign_conversational,0,mhoro\n')
    df = src.read_csv(spark, p, NATIVE_ROW)
    v = validate_verdict(validate_rows(df)).first()
    assert v.passed and v.rows == 2 and v.n_errors == 0


def test_bad_headers_fail(spark, tmp_dir):
    p = os.path.join(tmp_dir, "h.csv")
    _write(p, "hello,0\n", header="sentence,is_toxic\n")
    df = spark.read.option("header", True).csv(p)
    c = _checks(df)
    assert c["missing_columns"].n == 5
    assert not validate_verdict(validate_rows(df)).first().passed


def test_bad_label_and_edge_rows(spark, tmp_dir):
    p = os.path.join(tmp_dir, "e.csv")
    _write(p, "a,invalid_label,threat,2,x\n"
              "b,toxic,threat,2.5,x\n"
              "c,toxic,threat,x,x\n"
              "d,non-toxic,nope,5,x\n"
              "e,toxic,insult,NA,x\n"
              "a,toxic,insult,0,x\n"
              "NA,toxic,insult,1,x\n")
    df = src.read_csv(spark, p, NATIVE_ROW)
    c = _checks(df)
    assert c["invalid_label"].n == 1
    assert c["invalid_category"].n == 1
    assert c["severity_non_integer"].n == 2          # 'x' and NA
    assert "severity_out_of_range" not in c          # skipped when non-integer values exist
    assert c["null:severity"].n == 1 and c["null:text"].n == 1
    assert c["nontoxic_with_severity"].n == 1 and c["toxic_severity_zero"].n == 1
    assert c["duplicate_text"].n == 2 and c["duplicate_text"].value == "a"
    vals = {r.value for r in validate_rows(df).collect() if r.rule == "invalid_label_value"}
    assert vals == {"invalid_label"}
    assert not validate_verdict(validate_rows(df)).first().passed


def test_out_of_range_and_truncation(spark, tmp_dir):
    p = os.path.join(tmp_dir, "r.csv")
    _write(p, "a,toxic,threat,2.5,x\nb,toxic,threat,5,x\nc,toxic,threat,-1,x\n")
    c = _checks(src.read_csv(spark, p, NATIVE_ROW))
    assert c["severity_out_of_range"].n == 2


def test_empty_table_fails(spark, tmp_dir):
    p = os.path.join(tmp_dir, "empty.csv")
    _write(p, "")
    v = validate_verdict(validate_rows(src.read_csv(spark, p, NATIVE_ROW))).first()
    assert not v.passed and v.rows == 0


def test_custom_discovery(spark, tmp_dir):
    d = os.path.join(tmp_dir, "native")
    os.makedirs(d)
    _write(os.path.join(d, "custom_a.csv"), "x1,toxic,threat,4,l\nx2,non-toxic,insult,0,l\n")
    _write(os.path.join(d, "custom_bad.csv"), "y1,toxic,threat,x,l\n")             # non-integer: whole file skipped
    _write(os.path.join(d, "custom_cols.csv"), "z,1\n", header="text,is_toxic\n")   # lacks columns: skipped
    _write(os.path.join(d, "custom_shona_template.csv"), "t,toxic,threat,3,l\n")    # template <= 15 rows: skipped
    _write(os.path.join(d, "train.csv"), "w,toxic,threat,3,l\n")                    # reserved name
    _write(os.path.join(d, "custom_suffix.csv"), "v1,toxic,threat,2f,l\n")         # not a plain number: skipped
    _write(os.path.join(d, "my data.csv"), "u1,toxic,threat,99999999999,l\n")      # beyond INT: kept
    out = src.discover_custom(spark, d).collect()
    assert sorted((r.comment_text_sn, r.source) for r in out) == [
        ("u1", "custom_my data"), ("x1", "custom_custom_a"), ("x2", "custom_custom_a")]
    open(os.path.join(d, "nothing.csv"), "w").close()
    _write(os.path.join(d, "custom_bare.csv"), "")                                  # a header and no row
    _write(os.path.join(d, "custom_turned.csv"), '"a ""b"", c",1,threat,toxic\n', header="\ufefftext,severity,category,label\n")
    found = src.Discovery(spark, src.list_files(spark, d))
    verdicts = {r.name: (r.verdict, r.n_rows) for r in found.verdicts.collect()}
    assert verdicts == {"custom_a.csv": ("kept", 2), "custom_bad.csv": ("bad_severity", 1), "custom_cols.csv": ("missing_columns", 0),
                        "custom_shona_template.csv": ("template", 1), "train.csv": ("reserved", 0), "custom_suffix.csv": ("bad_severity", 1),
                        "my data.csv": ("kept", 1), "custom_bare.csv": ("empty", 0), "custom_turned.csv": ("kept", 1)}
    assert 'a "b", c' in {r.comment_text_sn for r in found.rows.collect()}
    x1 = [r for r in out if r.comment_text_sn == "x1"][0]
    assert (x1.toxic, x1.threat, x1.severe_toxic, x1.insult) == (1, 1, 1, 0)


def test_missing_input_guard(spark, tmp_dir):
    with pytest.raises(src.MissingInputError):
        src.require_paths(spark, os.path.join(tmp_dir, "nope"))
    assert src.discover_custom(spark, os.path.join(tmp_dir, "nope")) is None


def test_csv_roundtrip_and_na(spark, tmp_dir):
    from moderato.schema import COMMENT_ROW
    p = os.path.join(tmp_dir, "c.csv")
    _write(p, '1,"multi\nline, quoted",0,0,0,0,0,0\n2,NA,1,0,0,0,0,0\n3,,-1,-1,-1,-1,-1,-1\n',
           header="id,comment_text," + ",".join(LABELS) + "\n")
    rows = {r.id: r for r in src.scan_comments(spark, p).collect()}
    assert rows["1"].comment_text == "multi\nline, quoted"
    assert rows["2"].comment_text == "" and rows["3"].comment_text == ""
    out = os.path.join(tmp_dir, "out")
    src.scan_comments(spark, p).write.mode("overwrite").partitionBy("toxic").parquet(out)
    assert spark.read.parquet(out).filter(F.col("toxic") == -1).count() == 1


def test_validate_csv_file_api(spark, tmp_dir):
    from moderato.operators.validate import validate_verdict
    missing = src.validate_csv(spark, os.path.join(tmp_dir, "absent.csv"))
    assert not validate_verdict(missing).first().passed
    p = os.path.join(tmp_dir, "ok.csv")
    _write(p, "Mhoro,non-toxic,benign_conversational,0,mhoro\n")
    assert validate_verdict(src.validate_csv(spark, p)).first().passed


def test_write_splits_prunes(spark, tmp_dir):
    df = spark.createDataFrame([("train", "a", 0), ("test", "b", 1), ("validation", "c", 0)],
                               "split string, comment_text_sn string, toxic int")
    for fmt in ("parquet", "csv"):
        out = os.path.join(tmp_dir, f"splits_{fmt}")
        src.write_splits(df, out, fmt)
        assert sorted(f for f in os.listdir(out) if not f.startswith(".")) == ["_SUCCESS", "split=test", "split=train", "split=validation"]
        r = spark.read.format(fmt).option("header", True).load(out).filter(F.col("split") == "test")
        assert "PartitionFilters: [isnotnull(split" in r._jdf.queryExecution().executedPlan().toString() or \
            "split#" in r._jdf.queryExecution().executedPlan().toString()
        assert [x.comment_text_sn for x in r.collect()] == ["b"]
