"""Label predicates and the category -> six-label mapping."""

from __future__ import annotations

from functools import reduce
from operator import and_, add

from pyspark.sql import Column
from pyspark.sql import functions as F

from moderato.functions import lexicon as lx
from moderato.schema import LABELS


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def category_labels(category: Column | str, severity: Column | str,
                    is_toxic: Column | str) -> dict[str, Column]:
    """Six INT columns for an annotated row.

    Non-toxic -> all 0.  Toxic -> ``toxic`` plus the category's labels (an
    unknown category gives ``toxic`` only); at severity 4 some categories add
    ``obscene`` / ``severe_toxic``.  Each label is one boolean expression over
    INSET literals: no join with the category table is needed.
    """
    cat, sev, tox = _c(category), _c(severity), F.coalesce(_c(is_toxic), F.lit(False))
    sev4 = F.coalesce(sev == lx.SEVERE_LEVEL, F.lit(False))
    out = {}
    for lab in LABELS:
        cats = [c for c, labs in lx.CATEGORY_LABELS.items() if lab in labs]
        extra = (lx.SEV4_ADDS_OBSCENE if lab == "obscene" else []) + (
            lx.SEV4_ADDS_SEVERE_TOXIC if lab == "severe_toxic" else [])
        cond = F.lit(True) if lab == "toxic" else F.coalesce(cat.isin(cats), F.lit(False))
        if extra:
            cond = cond | (sev4 & F.coalesce(cat.isin(extra), F.lit(False)))
        out[lab] = F.when(tox & cond, F.lit(1)).otherwise(F.lit(0))
    return out


def scored_row(labels: list[str] | None = None) -> Column:
    """True when no label holds the -1 sentinel (P1).  NULL counts as scored."""
    labels = labels or LABELS
    return reduce(and_, [F.coalesce(F.col(l) != -1, F.lit(True)) for l in labels])


def label_sum(labels: list[str] | None = None) -> Column:
    labels = labels or LABELS
    return reduce(add, [F.coalesce(F.col(l), F.lit(0)) for l in labels])


def any_positive(labels: list[str] | None = None) -> Column:
    """Label sum > 0."""
    return label_sum(labels) > 0


def label_array(values: dict[str, Column]) -> Column:
    """Labels whose 0/1 column is 1, in LABELS order."""
    arr = F.array(*[F.when(values[l] == 1, F.lit(l)) for l in LABELS])
    return F.filter(arr, lambda x: x.isNotNull())
