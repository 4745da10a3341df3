"""Batch scoring and moderation.

A scorer adds six ``score_<label>`` DOUBLE columns.  Expression scorers are
plain Column expressions (JVM side, codegen).  Model scorers run in one pass over
Arrow batches that holds the models of all languages: each is built once per task, when its first row
comes, from a picklable factory; rows are masked by language and blankness, and a model is
fed mini-batches of its own rows.  Columns that no model reads go through as Arrow has them.  A model may
leave labels out; they score 0.0.  Moderation routes rows by language with
``when``: one scan, and rows never leave their partition, so there is no shuffle until a
summary is asked for.
"""

from __future__ import annotations

import time
from typing import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moderato.functions import lexicon as lx
from moderato.functions.language import detect_language
from moderato.functions.text import as_text, is_scoreable, tokens
from moderato.functions.thresholds import fill_scores, flagged_labels, resolve_thresholds, thresholds_map
from moderato.schema import LABELS

SCORE_COLS = [f"score_{l}" for l in LABELS]
TOKENS_COL = "_tokens"


def score_col(label: str) -> str:
    return f"score_{label}"


# ---------------------------------------------------------------- scorers
class Scorer:
    """Adds ``score_<label>`` columns for the text column."""

    name = "scorer"

    def score(self, df: DataFrame, text_col: str) -> DataFrame:  # pragma: no cover
        raise NotImplementedError


class ExpressionScorer(Scorer):
    """A scorer made of Column expressions only."""

    def columns(self, text: Column, toks: Column) -> dict[str, Column]:  # pragma: no cover
        raise NotImplementedError

    def score(self, df: DataFrame, text_col: str) -> DataFrame:
        toks = F.col(TOKENS_COL) if TOKENS_COL in df.columns else tokens(F.col(text_col))
        cols = self.columns(F.col(text_col), toks)
        return df.withColumns({score_col(l): cols[l] for l in LABELS})


class MarkerScorer(ExpressionScorer):
    """Deterministic scorer (U7): a marker substring in the lowered text gives
    ``label`` = ``hit``; every other score is ``miss``."""

    def __init__(self, markers=tuple(lx.EN_MARKERS), name="marker-en", label="toxic",
                 hit=lx.MARKER_HIT, miss=lx.MARKER_MISS):
        self.markers, self.name, self.label, self.hit, self.miss = list(markers), name, label, hit, miss

    def columns(self, text: Column, toks: Column) -> dict[str, Column]:
        low = F.lower(as_text(text))
        any_hit = F.lit(False)
        for m in self.markers:
            any_hit = any_hit | low.contains(m)
        return {l: (F.when(any_hit, F.lit(self.hit)).otherwise(F.lit(self.miss))
                    if l == self.label else F.lit(self.miss)) for l in LABELS}


class ConstantScorer(ExpressionScorer):
    """Every label scores ``value`` (e.g. zero base scores)."""

    def __init__(self, value=0.0, name="constant"):
        self.value, self.name = float(value), name

    def columns(self, text, toks):
        return {l: F.lit(self.value) for l in LABELS}


class ColumnScorer(ExpressionScorer):
    """Scores already present (or computable) as Columns, e.g. a fixture."""

    def __init__(self, fn: Callable[[], dict[str, Column]], name="columns"):
        self.fn, self.name = fn, name

    def columns(self, text, toks):
        return self.fn()


def benign_whitelisted(toks: Column) -> Column:
    """1..10 tokens, none known-toxic, at least one benign, and every
    token benign or at most two characters long."""
    benign = list(lx.BENIGN_TOKENS)
    n = F.size(toks)
    return ((n >= 1) & (n <= lx.WHITELIST_MAX_TOKENS)
            & ~F.exists(toks, lambda t: t.isin(lx.KNOWN_TOXIC_TOKENS))
            & F.exists(toks, lambda t: t.isin(benign))
            & F.forall(toks, lambda t: t.isin(benign) | (F.length(t) <= lx.WHITELIST_SHORT_TOKEN)))


def slur_floors(toks: Column) -> dict[str, Column]:
    """Per label, the highest floor over the comment's tokens (0.0 if none)."""
    out = {}
    for lab in LABELS:
        entries = [(tok, m[lab]) for tok, m in lx.SLUR_FLOORS.items() if lab in m]
        if not entries:
            out[lab] = F.lit(0.0)
            continue
        fmap = F.create_map(*[x for tok, v in entries for x in (F.lit(tok), F.lit(float(v)))])
        per_tok = F.transform(toks, lambda t: F.coalesce(F.element_at(fmap, t), F.lit(0.0)))
        out[lab] = F.coalesce(F.array_max(per_tok), F.lit(0.0))
    return out


def shona_adjust(scores: dict[str, Column], toks: Column) -> dict[str, Column]:
    """F4 or F5: whitelisted benign text caps every score at 0.02, otherwise
    each score is raised to its lexical floor."""
    white = benign_whitelisted(toks)
    floors = slur_floors(toks)
    return {l: F.when(white, F.least(scores[l], F.lit(lx.WHITELIST_CAP)))
            .otherwise(F.greatest(scores[l], floors[l])) for l in LABELS}


class ShonaScorer(Scorer):
    """A base scorer followed by the Shona whitelist / lexical floors."""

    def __init__(self, base: Scorer | None = None, name=None):
        self.base = base or MarkerScorer(lx.SN_MARKERS, name="marker-sn")
        self.name = name or self.base.name

    @property
    def is_expression(self):
        return isinstance(self.base, ExpressionScorer)

    def columns(self, text: Column, toks: Column) -> dict[str, Column]:
        return shona_adjust(self.base.columns(text, toks), toks)

    def score(self, df: DataFrame, text_col: str) -> DataFrame:
        toks = F.col(TOKENS_COL) if TOKENS_COL in df.columns else tokens(F.col(text_col))
        if self.is_expression:
            cols = self.columns(F.col(text_col), toks)
            return df.withColumns({score_col(l): cols[l] for l in LABELS})
        scored = self.base.score(df, text_col)
        toks = F.col(TOKENS_COL) if TOKENS_COL in scored.columns else tokens(F.col(text_col))
        adj = shona_adjust({l: F.col(score_col(l)) for l in LABELS}, toks)
        return scored.withColumns({score_col(l): adj[l] for l in LABELS})


class PandasScorer(Scorer):
    """A model run over Arrow batches.

    ``factory()`` is called once per task and returns ``predict(texts)``, which gives either an
    array-like of shape (n, 6) (LABELS order) or one dict (label -> score) per text, which
    may lack labels.  Texts are fed in mini-batches
    of ``batch_size``.  ``max_chars`` truncates ahead of the model.
    """

    def __init__(self, factory: Callable[[], Callable], name="pandas-model", batch_size=32,
                 max_chars: int | None = None):
        self.factory, self.name, self.batch_size, self.max_chars = factory, name, batch_size, max_chars

    def score(self, df: DataFrame, text_col: str) -> DataFrame:
        df = df.drop(*[c for c in SCORE_COLS if c in df.columns])
        one = df.withColumns({_ROUTE: F.lit("en"), _OK: F.lit(True)})
        filled = fill_scores(F.col(_SCORES))
        return routed_scores(one, text_col, {"en": self}).withColumns({score_col(l): filled[l] for l in LABELS}).drop(_ROUTE, _OK, _SCORES)


_ROUTE, _OK, _SCORES = "_route", "_scoreable", "_scores"


def routed_scores(df: DataFrame, text_col: str, models: dict[str, PandasScorer]) -> DataFrame:
    """Adds ``_scores``, a ``MAP<STRING,DOUBLE>``: what the model of a row's ``_route`` says of its text.
    Rows that aren't ``_scoreable``, and routes without a model, get NULL."""
    names = df.columns
    at_text, at_route, at_ok = names.index(text_col), names.index(_ROUTE), names.index(_OK)
    models = dict(models)

    def run(batches):
        built = {}
        for batch in batches:
            ok = np.asarray(batch.column(at_ok).fill_null(False))
            route = np.asarray(batch.column(at_route).to_pylist(), dtype=object)
            found = [None] * batch.num_rows
            for lang, model in models.items():
                mine = np.flatnonzero(ok & (route == lang))
                if not len(mine):
                    continue
                if lang not in built:
                    built[lang] = model.factory()
                texts = [t or "" for t in batch.column(at_text).take(pa.array(mine)).to_pylist()]
                if model.max_chars:
                    texts = [t[:model.max_chars] for t in texts]
                for i in range(0, len(texts), model.batch_size):
                    said = built[lang](texts[i:i + model.batch_size])
                    for at, one in zip(mine[i:i + model.batch_size].tolist(), said, strict=True):
                        found[at] = list(one.items() if isinstance(one, dict) else zip(LABELS, map(float, one), strict=True))
            scores = pa.array(found, pa.map_(pa.string(), pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*names, _SCORES])
    schema = T.StructType([*df.schema.fields, T.StructField(_SCORES, T.MapType(T.StringType(), T.DoubleType()))])
    return df.mapInArrow(run, schema)


def marker_predictor(markers=tuple(lx.EN_MARKERS), label="toxic", hit=lx.MARKER_HIT, miss=lx.MARKER_MISS):
    """Factory of a vectorised pandas marker model (the U7 stub as a U3 model)."""
    markers, j = list(markers), LABELS.index(label)

    def make():
        def predict(texts):
            s = pd.Series(texts, dtype="object").str.lower()
            hit_mask = np.zeros(len(s), dtype=bool)
            for m in markers:
                hit_mask |= s.str.contains(m, regex=False).to_numpy()
            mat = np.full((len(s), len(LABELS)), miss, dtype="float64")
            mat[:, j] = np.where(hit_mask, hit, miss)
            return mat
        return predict
    return make


def marker_mapper(markers=tuple(lx.EN_MARKERS), label="toxic", hit=lx.MARKER_HIT, miss=lx.MARKER_MISS):
    """Factory of a marker model that only ever names one label."""
    markers = list(markers)

    def make():
        return lambda texts: [{label: hit if any(m in t.lower() for m in markers) else miss} for t in texts]
    return make


# ---------------------------------------------------------------- moderation
def _model_of(scorer: Scorer) -> PandasScorer | None:
    inner = scorer.base if isinstance(scorer, ShonaScorer) else scorer
    return inner if isinstance(inner, PandasScorer) else None


def _is_expression(scorer: Scorer) -> bool:
    return isinstance(scorer, ExpressionScorer) or (isinstance(scorer, ShonaScorer) and scorer.is_expression)


def _by_row(df: DataFrame, text_col: str, scorers: dict[str, Scorer]) -> DataFrame:
    """Scores each row by the scorer of its ``_route`` (blank rows 0.0): one
    pass over the rows, whatever mix of expressions and models.  Needs TOKENS_COL."""
    models = {lang: m for lang, sc in scorers.items() if (m := _model_of(sc))}
    if models:
        # The token arrays needn't go through the models.
        df = routed_scores(df.drop(TOKENS_COL), text_col, models).withColumn(TOKENS_COL, tokens(F.col(text_col)))
    toks, filled, cols = F.col(TOKENS_COL), fill_scores(F.col(_SCORES)), {}
    for lang, sc in scorers.items():
        if _is_expression(sc):
            cols[lang] = sc.columns(F.col(text_col), toks)
        else:
            cols[lang] = shona_adjust(filled, toks) if isinstance(sc, ShonaScorer) else filled
    out = {}
    for l in LABELS:
        c = F.when(~F.col(_OK), F.lit(0.0))
        for lang in scorers:
            c = c.when(F.col(_ROUTE) == lang, cols[lang][l])
        out[score_col(l)] = c
    return df.withColumns(out).drop(_SCORES)


def _score_branch(df: DataFrame, scorer: Scorer, text_col: str) -> DataFrame:
    """A scorer that needs whole tables (it joins): blank rows skip it."""
    live = scorer.score(df.filter(F.col(_OK)), text_col)
    blank = df.filter(~F.col(_OK)).withColumns({c: F.lit(0.0) for c in SCORE_COLS})
    return live.unionByName(blank)


def moderate(df: DataFrame, text_col: str = "text", language: str | Column = "en",
             thresholds: Column | dict | None = None, global_threshold: float | None = None,
             per_label: dict | None = None, en_scorer: Scorer | None = None,
             sn_scorer: Scorer | None = None) -> DataFrame:
    """Resolve thresholds, detect language if ``auto``, route, score, flag.

    Adds ``language, model, score_<label> x6, flagged_labels, is_toxic,
    thresholds_used``.  ``thresholds`` is a per-request dict or a per-row
    ``MAP<STRING,DOUBLE>`` column.
    """
    en_scorer = en_scorer or MarkerScorer()
    sn_scorer = sn_scorer or ShonaScorer()
    text = F.col(text_col)
    # Tokens are computed once per row and referenced by every later
    # expression (Catalyst keeps a non-cheap column that is used many times
    # in its own projection instead of inlining it).
    df = df.withColumn(TOKENS_COL, tokens(text))
    toks = F.col(TOKENS_COL)
    if isinstance(language, str) and language == "auto":
        lang = detect_language(toks=toks, default="en")
    elif isinstance(language, str):
        lang = F.lit(language)
    else:
        # A row may carry its own language: "auto" is detected, NULL is the default.
        lang = F.when(language == "auto", detect_language(toks=toks, default="en")).otherwise(
            F.coalesce(language, F.lit("en")))
    thr = resolve_thresholds(thresholds, global_threshold, per_label)
    is_sn = F.col("language") == "sn"
    base = df.withColumn("language", lang).withColumns({
        _OK: is_scoreable(text), _ROUTE: F.when(is_sn, F.lit("sn")).otherwise(F.lit("en")),
        "model": F.when(is_sn, F.lit(sn_scorer.name)).otherwise(F.lit(en_scorer.name))})
    scorers = {"sn": sn_scorer, "en": en_scorer}
    if all(_is_expression(s) or _model_of(s) for s in scorers.values()):
        scored = _by_row(base, text_col, scorers)
    else:
        parts = [_by_row(rows, text_col, {lang: sc}) if _is_expression(sc) or _model_of(sc) else _score_branch(rows, sc, text_col)
                 for lang, sc in scorers.items() for rows in [base.filter(F.col(_ROUTE) == lang)]]
        scored = parts[0].unionByName(parts[1])

    scores = {l: F.col(score_col(l)) for l in LABELS}
    flagged = flagged_labels(scores, thr, F.col("_scoreable"))
    return (scored.withColumn("flagged_labels", flagged)
            .withColumn("is_toxic", F.size("flagged_labels") > 0)
            .withColumn("thresholds_used", thresholds_map(thr))
            .drop(_OK, _ROUTE, TOKENS_COL))


def score_batch(df: DataFrame, text_col: str, scorer: Scorer, threshold=0.5) -> DataFrame:
    """Score every row (blank rows 0.0) and flag at a normalised threshold (U4)."""
    from moderato.functions.thresholds import normalize_thresholds
    base = df.withColumns({TOKENS_COL: tokens(F.col(text_col)), _OK: is_scoreable(F.col(text_col)), _ROUTE: F.lit("en")})
    one_pass = _is_expression(scorer) or _model_of(scorer)
    scored = _by_row(base, text_col, {"en": scorer}) if one_pass else _score_branch(base, scorer, text_col)
    thr = normalize_thresholds(threshold)
    flagged = flagged_labels({l: F.col(score_col(l)) for l in LABELS}, thr, F.col(_OK))
    return (scored.withColumn("flagged_labels", flagged)
            .withColumn("is_toxic", F.size("flagged_labels") > 0).drop(_OK, _ROUTE, TOKENS_COL))


def batch_summary(moderated: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``total`` and ``flagged_count`` per batch key (one partial
    aggregate per partition, so a hot batch key costs one row per task)."""
    aggs = [F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("is_toxic")).alias("flagged_count")]
    return moderated.groupBy(*(by or [])).agg(*aggs)


def observed_write(df: DataFrame, path: str, metrics: dict[str, Column]) -> tuple[dict, float]:
    """Writes ``df`` as Parquet and returns aggregates of what was written, taken during
    that one pass, and the seconds it took."""
    seen = Observation()
    start = time.monotonic()
    df.observe(seen, *[c.alias(n) for n, c in metrics.items()]).write.parquet(path)
    return seen.get, time.monotonic() - start


class CalibratedScorer(Scorer):
    """U5 with a trained ``CalibratedModel``: TF-IDF features and calibrated
    per-label probabilities, made where the rows lie."""

    def __init__(self, model, name: str = "calibrated-shona"):
        self.model, self.name = model, name

    def score(self, df: DataFrame, text_col: str) -> DataFrame:
        return self.model.predict(df, text_col, prefix=score_col(""))
