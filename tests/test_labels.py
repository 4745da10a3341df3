"""Category -> label mapping (P4), sentinel and positive predicates."""

import itertools

import pytest
from pyspark.sql import functions as F

from moderato.functions.labels import any_positive, category_labels, scored_row
from moderato.functions.lexicon import CATEGORY_LABELS
from moderato.schema import LABELS


def _labels(spark, rows):
    df = spark.createDataFrame(rows, "category string, severity int, is_toxic boolean")
    labs = category_labels(F.col("category"), F.col("severity"), F.col("is_toxic"))
    out = df.select("category", "severity", "is_toxic", *[labs[l].alias(l) for l in LABELS]).collect()
    return {(r.category, r.severity, r.is_toxic): {l for l in LABELS if r[l] == 1} for r in out}


CASES = [
    ("threat", 3, True, {"toxic", "threat"}),
    ("threat", 4, True, {"toxic", "threat", "severe_toxic"}),
    ("insult", 4, True, {"toxic", "insult"}),
    ("maternal_insult", 4, True, {"toxic", "insult", "obscene", "severe_toxic"}),
    ("maternal_insult", 2, True, {"toxic", "insult"}),
    ("profanity", 4, True, {"toxic", "obscene"}),
    ("sexual_slur", 4, True, {"toxic", "obscene", "insult", "severe_toxic"}),
    ("ethnic_hate", 3, True, {"toxic", "insult", "identity_hate"}),
    ("ableist", 4, True, {"toxic", "insult", "identity_hate", "severe_toxic"}),
    ("dehumanising", 4, True, {"toxic", "insult", "severe_toxic"}),
    ("literal_or_metalinguistic", 4, True, {"toxic"}),
    ("no_such_category", 4, True, {"toxic"}),
    (None, 4, True, {"toxic"}),
    ("threat", 4, False, set()),
    ("insult", None, True, {"toxic", "insult"}),
]


def test_mapping_cases(spark):
    got = _labels(spark, [(c, s, t) for c, s, t, _ in CASES])
    for c, s, t, want in CASES:
        assert got[(c, s, t)] == want, (c, s, t)


def test_only_threat_sets_threat_sweep(spark):
    cats = [c for c in CATEGORY_LABELS if c != "threat"][:15]
    rows = list(itertools.product(cats, range(5), [True]))
    got = _labels(spark, rows)
    assert len(got) == 75
    assert all("threat" not in v for v in got.values())
    assert all("toxic" in v for v in got.values())


def test_sentinel_and_positive(spark):
    schema = ", ".join(f"{l} int" for l in LABELS)
    df = spark.createDataFrame([(0,) * 6, (1, 0, 0, 0, 0, 0), (-1,) * 6, (None, 0, 0, 0, 0, 0)], schema)
    out = df.select(scored_row().alias("s"), any_positive().alias("p")).collect()
    assert [r.s for r in out] == [True, True, False, True]
    assert [r.p for r in out] == [False, True, False, False]
