"""DuckDB oracle SQL for the named queries (same column names)."""

from __future__ import annotations

from moderato.functions import lexicon as lx
from moderato.plans import sqlfrag as S
from moderato.schema import DEFAULT_THRESHOLDS, LABELS

ORACLES: dict[str, str] = {}


def _moderated_sql(table: str, key: str, text: str = "text", language: str = "auto",
                   thr: dict | None = None, sn_base: str = "marker", sn_name: str = "marker-sn", en_name: str = "marker-en",
                   ask: str | None = None, other: float = lx.MARKER_MISS) -> str:
    """Per-row moderation of ``table`` with the marker scorers; ``ask`` is a row's own
    language, ``other`` the score of labels that no marker gives."""
    thr = thr or {l: DEFAULT_THRESHOLDS[l] for l in LABELS}
    toks = "toks"
    lang = S.decide(S.en_evidence(toks), S.sn_evidence(toks)) if language == "auto" else S.q(language)
    if ask:
        lang = f"CASE WHEN {ask} = 'auto' THEN {lang} ELSE coalesce({ask}, 'en') END"
    en = {l: S.marker_score(l, "low", lx.EN_MARKERS, other=other) for l in LABELS}
    base = {l: (S.marker_score(l, "low", lx.SN_MARKERS, other=other) if sn_base == "marker" else S.d(0.0)) for l in LABELS}
    sn = {l: S.shona_adjust(base[l], l, toks) for l in LABELS}
    score_sel = ",\n      ".join(
        f"CASE WHEN NOT scoreable THEN {S.d(0.0)} WHEN language = 'sn' THEN {sn[l]} ELSE {en[l]} END AS s_{l}"
        for l in LABELS)
    flag_list = S.flagged({l: f"s_{l}" for l in LABELS}, thr, "scoreable")
    return f"""
WITH base AS (
  SELECT {key}, {text} AS text, {S.tokens(text)} AS toks, lower(coalesce({text}, '')) AS low,
         {S.scoreable(text)} AS scoreable
  FROM {table}),
lang AS (SELECT *, {lang} AS language FROM base),
sc AS (
  SELECT {key}, language, scoreable,
      CASE WHEN language = 'sn' THEN '{sn_name}' ELSE '{en_name}' END AS model,
      {score_sel}
  FROM lang),
fl AS (SELECT *, {flag_list} AS fl_list FROM sc)
"""


ORACLES["moderate_auto"] = _moderated_sql("documents", "doc_id") + f"""
SELECT doc_id, language, model, {', '.join(f's_{l}' for l in LABELS)},
       array_to_string(fl_list, ',') AS flagged, len(fl_list) > 0 AS is_toxic
FROM fl"""

ORACLES["batch_summary"] = _moderated_sql("conversations", "conv_id") + """
SELECT conv_id, count(*) AS total, CAST(count(*) FILTER (WHERE len(fl_list) > 0) AS BIGINT) AS flagged_count
FROM fl GROUP BY conv_id"""


ORACLES["clean_text"] = f"SELECT doc_id, {S.clean_text('text')} AS clean FROM documents"

ORACLES["tokens"] = f"""SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens
FROM (SELECT doc_id, {S.tokens('text')} AS t FROM documents)"""

_TRUNC = "replace(substr(coalesce(text, ''), 1, 400), chr(10), ' ')"
ORACLES["truncate_text"] = f"SELECT doc_id, {S.strip(_TRUNC)} AS truncated FROM documents"

_MIXED = S.mixed()
_DRAWN = S.drawn()

ORACLES["scoreable"] = f"""
SELECT 'line' AS kind, id, {S.scoreable('text')} AS scoreable FROM {_MIXED}
UNION ALL
SELECT 'turn' AS kind, conv_id * 1000 + turn AS id, {S.scoreable('text')} AS scoreable FROM conversations"""

_LANG_BASE = f"""
WITH t AS (SELECT doc_id, lang, {S.tokens('text')} AS toks FROM documents),
ev AS (SELECT doc_id, lang, {S.en_evidence('toks')} AS en_score, {S.sn_evidence('toks')} AS sn_score FROM t),
dl AS (SELECT *, {S.decide('en_score', 'sn_score')} AS language FROM ev)"""

ORACLES["detect_language"] = _LANG_BASE + "\nSELECT doc_id, en_score, sn_score, language FROM dl"
ORACLES["language_mix"] = _LANG_BASE + "\nSELECT lang, language, count(*) AS n FROM dl GROUP BY lang, language"

_LEX_ROWS = ", ".join(f"({S.q(t)}, {S.q(k)})" for t, k in dict.fromkeys(
    [(w, "en_word") for w in lx.EN_WORDS] + [(w, "sn_word") for w in lx.SN_WORDS]
    + [(w, "benign") for w in lx.BENIGN_TOKENS] + [(w, "known_toxic") for w in lx.KNOWN_TOXIC_TOKENS]
    + [(w, "floor") for w in lx.SLUR_FLOORS]))
ORACLES["lexicon_hits"] = f"""
WITH lex(term, kind) AS (VALUES {_LEX_ROWS}),
t AS (SELECT id, unnest({S.tokens('text')}) AS term FROM {_MIXED})
SELECT kind, t.term AS term, count(*) AS hits, count(DISTINCT id) AS docs
FROM t JOIN lex ON t.term = lex.term GROUP BY kind, t.term"""

ORACLES["lexical_floors"] = f"""
SELECT id, {', '.join(f'round({S.floor(l, "toks")}, 6) AS f_{l}' for l in LABELS)}
FROM (SELECT id, {S.tokens('text')} AS toks FROM {_MIXED})"""

ORACLES["benign_cap"] = f"""
WITH t AS (SELECT id, {S.tokens('text')} AS toks FROM {_MIXED})
SELECT id, {S.whitelisted('toks')} AS whitelisted,
       {', '.join(f'round({S.shona_adjust(S.fixture_score(l, "id"), l, "toks")}, 6) AS s_{l}' for l in LABELS)}
FROM t"""

_sig = {l: f"(1.0 / (1.0 + exp(-(({S.fixture_score(l, 'doc_id')}) - 0.5) * 8.0)))" for l in LABELS}
ORACLES["sigmoid_flags"] = f"""
SELECT doc_id, {', '.join(f'round({_sig[l]}, 6) AS p_{l}' for l in LABELS)},
       array_to_string({S.flagged(_sig, {l: 0.5 for l in LABELS})}, ',') AS flagged
FROM documents"""

_cl = S.category_labels_sql("category", "severity", "label = 'toxic'")
ORACLES["category_labels"] = f"""
SELECT doc_id, label, category, severity, {', '.join(f'{_cl[l]} AS {l}' for l in LABELS)}
FROM {S.ANNOTATED}"""

_scored_cond = " AND ".join(f"coalesce({l} <> -1, TRUE)" for l in LABELS)
ORACLES["drop_unscored"] = f"SELECT doc_id, {', '.join(LABELS)} FROM {S.comment_table()} WHERE {_scored_cond}"

_lsum = " + ".join(f"coalesce({l}, 0)" for l in LABELS)
ORACLES["positive_counts"] = f"""
SELECT count(*) AS n, count(*) FILTER (WHERE {_lsum} > 0) AS n_positive,
       count(*) FILTER (WHERE {_lsum} = 0) AS n_negative,
       {', '.join(f'CAST(sum({l}) AS BIGINT) AS pos_{l}' for l in LABELS)}
FROM {S.comment_table()} WHERE {_scored_cond}"""

_fx = {l: S.fixture_score(l, "doc_id") for l in LABELS}
_fl = S.flagged(_fx, {l: DEFAULT_THRESHOLDS[l] for l in LABELS}, S.scoreable("text"))
ORACLES["flag_labels"] = f"""
SELECT doc_id, array_to_string(fl, ',') AS flagged, len(fl) > 0 AS is_toxic
FROM (SELECT doc_id, {_fl} AS fl FROM documents)"""

ORACLES["flag_uniform"] = f"""
SELECT doc_id, array_to_string({S.flagged(_fx, {l: 0.5 for l in LABELS})}, ',') AS flagged FROM documents"""


def _thr_sql(l):
    chain = []
    if l == "toxic":
        chain.append("CAST((doc_id % 10) / 10.0 AS DOUBLE)")
    if l == "insult":
        chain.append("CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(0.45 AS DOUBLE) END")
    if l == "obscene":
        chain.append(S.d(0.7))
    chain.append(S.d(DEFAULT_THRESHOLDS[l]))
    return f"coalesce({', '.join(chain)})"


ORACLES["resolve_thresholds"] = f"SELECT doc_id, {', '.join(f'{_thr_sql(l)} AS t_{l}' for l in LABELS)} FROM documents"

_REJECT = """CASE WHEN text IS NULL THEN 'missing_text' WHEN length(text) < 1 THEN 'empty_text'
             WHEN length(text) > 5000 THEN 'text_too_long'
             WHEN NOT coalesce(lang IN ('en', 'sn', 'auto'), FALSE) THEN 'bad_language' END AS reason"""
ORACLES["request_reject"] = f"""
SELECT kind, id, CAST(length(text) AS BIGINT) AS n, reason IS NULL AS valid, reason
FROM (SELECT 'document' AS kind, doc_id AS id, text, {_REJECT} FROM documents
      UNION ALL SELECT 'line' AS kind, id, text, {_REJECT} FROM {_MIXED})
UNION ALL
SELECT 'pasted' AS kind, id, n, reason IS NULL AS valid, reason
FROM (SELECT id // 1000000 AS id, count(*) AS n, CASE WHEN count(*) > 100 THEN 'batch_too_large' END AS reason FROM {_MIXED} GROUP BY 1)
UNION ALL
SELECT 'turns' AS kind, conv_id AS id, n, FALSE AS valid, CASE WHEN n > 100 THEN 'batch_too_large' ELSE 'bad_language' END AS reason
FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)"""

ORACLES["split_lines"] = f"""
WITH b AS (
  SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {S.strip('x')}),
                             lambda x: length(x) > 0) AS lines FROM documents)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, lines[i] AS line, len(lines) AS n_lines,
       len(lines) BETWEEN 1 AND 100 AS accepted
FROM b, LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i)"""


_MOD_SELECT = f"""
SELECT doc_id, language, model, {', '.join(f's_{l}' for l in LABELS)},
       array_to_string(fl_list, ',') AS flagged, len(fl_list) > 0 AS is_toxic
FROM fl"""
ORACLES["moderate_en"] = _moderated_sql("documents", "doc_id", language="en") + _MOD_SELECT
ORACLES["moderate_sn"] = _moderated_sql(_MIXED, "id", language="sn", sn_base="zero",
                                        sn_name="zero-sn") + _MOD_SELECT.replace("doc_id", "id")
_ASK = S.digits_of("ask", "id", 0)
ORACLES["moderate_requests"] = _moderated_sql(
    _MIXED, "id", ask=f"(CASE WHEN {_ASK} < 4 THEN 'en' WHEN {_ASK} < 8 THEN 'sn' WHEN {_ASK} < 13 THEN 'auto' END)",
    thr={l: _thr_sql(l).replace("doc_id", "id") for l in LABELS}, en_name="model-en", sn_name="model-sn", other=0.0) + _MOD_SELECT.replace("doc_id", "id")
ORACLES["score_throughput"] = _moderated_sql(_MIXED, "id") + """
SELECT count(*) AS n, count(*) FILTER (WHERE len(fl_list) > 0) AS n_toxic, count(*) FILTER (WHERE language = 'sn') AS n_sn, TRUE AS has_rate FROM fl"""
_u = {l: 0.5 for l in LABELS}
ORACLES["score_batch"] = f"""
WITH b AS (SELECT doc_id, lower(coalesce(text, '')) AS low, {S.scoreable('text')} AS ok FROM documents),
s AS (SELECT doc_id, ok, {', '.join(f'CASE WHEN ok THEN {S.marker_score(l, "low", lx.EN_MARKERS)} ELSE {S.d(0.0)} END AS s_{l}' for l in LABELS)} FROM b),
f AS (SELECT *, {S.flagged({l: f's_{l}' for l in LABELS}, _u, 'ok')} AS fl FROM s)
SELECT doc_id, {', '.join(f's_{l}' for l in LABELS)}, array_to_string(fl, ',') AS flagged, len(fl) > 0 AS is_toxic FROM f"""


# ------------------------------------------------------------ validation & sources
_VAL_INS = {"clean": f"(SELECT doc_id, text, label, category, severity::VARCHAR AS severity, source AS source_lemma FROM {S.ANNOTATED})",
            "broken": S.raw_annotated(), "not_numeric": S.raw_annotated(numeric=False)}
_SEVN = ("CASE WHEN isnan(TRY_CAST(CAST(severity AS VARCHAR) AS DOUBLE)) OR isinf(TRY_CAST(CAST(severity AS VARCHAR) AS DOUBLE))"
         " THEN NULL ELSE TRY_CAST(CAST(severity AS VARCHAR) AS DOUBLE) END")
_CHECKS = [("rows", "info", "count(*)")]
_CHECKS += [(f"null:{c}", "error", f"count(*) FILTER (WHERE {c} IS NULL)")
            for c in ("text", "label", "category", "severity", "source_lemma")]
_CHECKS += [
    ("invalid_label", "error", "count(*) FILTER (WHERE NOT coalesce(label IN ('toxic', 'non-toxic'), FALSE))"),
    ("invalid_category", "error", f"count(*) FILTER (WHERE NOT coalesce(category IN {S.in_list(lx.VALID_CATEGORIES)}, FALSE))"),
    ("severity_non_integer", "error", "count(*) FILTER (WHERE sevn IS NULL)"),
    ("severity_out_of_range", "error", "count(*) FILTER (WHERE CAST(trunc(sevn) AS INTEGER) < 0 OR CAST(trunc(sevn) AS INTEGER) > 4)"),
    ("nontoxic_with_severity", "warning", "count(*) FILTER (WHERE label = 'non-toxic' AND sevn > 0)"),
    ("toxic_severity_zero", "warning", "count(*) FILTER (WHERE label = 'toxic' AND sevn = 0)"),
]


def _validate_sql(src_sql: str) -> str:
    wide = ", ".join(f'CAST({e} AS BIGINT) AS "{n}"' for n, _, e in _CHECKS)
    longs = " UNION ALL ".join(
        f"SELECT '{n}' AS rule, '{lv}' AS level, \"{n}\" AS n, \"severity_non_integer\" AS nonint FROM w"
        for n, lv, _ in _CHECKS)
    bad_vals = " UNION ALL ".join(
        f"SELECT '{name}_value' AS rule, 'error' AS level, count(*) AS n, CAST({c} AS VARCHAR) AS value "
        f"FROM a WHERE NOT coalesce({c} IN {vals}, FALSE) GROUP BY CAST({c} AS VARCHAR)"
        for name, c, vals in (("invalid_label", "label", "('toxic', 'non-toxic')"),
                              ("invalid_category", "category", S.in_list(lx.VALID_CATEGORIES))))
    return f"""
WITH a AS (SELECT *, {_SEVN} AS sevn FROM {src_sql}),
w AS (SELECT {wide} FROM a),
l AS ({longs}),
g AS (SELECT text, count(*) AS c, min(doc_id) AS o FROM a GROUP BY text HAVING count(*) > 1)
SELECT rule, level, n, CAST(NULL AS VARCHAR) AS value FROM l
WHERE rule = 'rows' OR (n > 0 AND (rule <> 'severity_out_of_range' OR nonint = 0))
UNION ALL
SELECT 'duplicate_text', 'warning', CAST(sum(c) AS BIGINT), substr(arg_min(text, o), 1, 40) FROM g HAVING sum(c) > 0
UNION ALL {bad_vals}"""


_VALIDATED = {name: _validate_sql(src) for name, src in _VAL_INS.items()}
ORACLES["validate_rows"] = " UNION ALL ".join(f"SELECT *, '{name}' AS input FROM ({sql})" for name, sql in _VALIDATED.items())
ORACLES["validate_verdict"] = " UNION ALL ".join(f"""
SELECT CAST(coalesce(max(CASE WHEN rule = 'rows' THEN n END), 0) AS BIGINT) AS rows,
       count(*) FILTER (WHERE level = 'error' AND NOT suffix(rule, '_value')) AS n_errors,
       count(*) FILTER (WHERE level = 'warning') AS n_warnings,
       NOT coalesce(bool_or(level = 'error' OR (rule = 'rows' AND n = 0)), FALSE) AS passed, '{name}' AS input
FROM ({sql})""" for name, sql in _VALIDATED.items())

ORACLES["duplicate_text"] = """
WITH g AS (SELECT text, count(*) AS c, min(doc_id) AS o FROM documents GROUP BY text HAVING count(*) > 1)
SELECT 'duplicate_text' AS rule, 'warning' AS level, CAST(sum(c) AS BIGINT) AS n,
       substr(arg_min(text, o), 1, 40) AS value FROM g HAVING sum(c) > 0"""

ORACLES["category_counts"] = f"""
SELECT 'category' AS field, category AS value, count(*) AS n FROM {S.ANNOTATED} GROUP BY category
UNION ALL
SELECT 'label' AS field, label AS value, count(*) AS n FROM {S.ANNOTATED} GROUP BY label"""

ORACLES["scan_comments"] = f"SELECT doc_id, coalesce(comment_text, '') AS comment_text, {', '.join(LABELS)} FROM {S.comment_table()}"

_NL = S.category_labels_sql("category", "severity", "label = 'toxic'")
_NATIVE = f"""(SELECT doc_id, '' AS comment_text_en, text AS comment_text_sn,
    {', '.join(f'{_NL[l]} AS {l}' for l in LABELS)}, 'native_lexicon' AS source FROM {S.ANNOTATED})"""
ORACLES["native_rows"] = f"SELECT * FROM {_NATIVE}"
_BASE_NAME = "regexp_extract(file, '([^/]+)$', 1)"
_GOOD_FILES = f"""(SELECT file FROM (SELECT *, TRY_CAST(CASE WHEN regexp_full_match(severity, '\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*')
        THEN severity END AS DOUBLE) AS sev FROM {S.FILED})
   WHERE {_BASE_NAME} NOT IN ('clean_conversational.csv', 'full.csv', 'train.csv', 'test.csv', 'validation.csv')
   GROUP BY file HAVING count(*) = count(sev) AND NOT ({_BASE_NAME} = 'custom_shona_template.csv' AND count(*) <= 15))"""
_FL = S.category_labels_sql("category", "least(TRY_CAST(severity AS BIGINT), 2147483647)", "label = 'toxic'")
_CUSTOM = f"""(SELECT doc_id, '' AS comment_text_en, text AS comment_text_sn,
    {', '.join(f'{_FL[l]} AS {l}' for l in LABELS)}, 'custom_' || regexp_extract(file, '([^/]+)\\.csv$', 1) AS source
  FROM {S.FILED} WHERE file IN (SELECT file FROM {_GOOD_FILES}))"""
ORACLES["custom_discovery"] = f"""
SELECT f AS file, header, n AS n_rows, bad AS bad_severities, verdict
FROM (SELECT f, header, n, bad, CASE WHEN name = 'full.csv' THEN 'reserved' WHEN header = 'text,label' THEN 'missing_columns' WHEN bad > 0 THEN 'bad_severity'
        WHEN name = 'custom_shona_template.csv' AND n <= 15 THEN 'template' ELSE 'kept' END AS verdict
      FROM (SELECT substr(file, 7) AS f, regexp_extract(file, '([^/]+)$', 1) AS name,
              any_value(CASE source WHEN 'src4' THEN 'severity,category,label,text' WHEN 'src5' THEN 'text,label' ELSE 'text,label,category,severity,source' END) AS header,
              count(*) FILTER (WHERE source NOT IN ('src0', 'src5')) AS n, count(*) FILTER (WHERE severity = '2x') AS bad
            FROM {S.FILED} GROUP BY file))"""
ORACLES["custom_sources"] = f"SELECT doc_id, {', '.join(LABELS)}, source FROM {_CUSTOM}"

# ------------------------------------------------------------ sampling & splits
_KEY = "md5('42:' || CAST({id} AS VARCHAR))"
_SCORED = f"(SELECT doc_id, {', '.join(LABELS)} FROM {S.comment_table()} WHERE {_scored_cond})"

ORACLES["shuffled"] = f"SELECT doc_id, row_number() OVER (ORDER BY {_KEY.format(id='doc_id')}, doc_id) AS pos FROM documents"
_SCORED_LINES = f"(SELECT id, {', '.join(LABELS)} FROM {_DRAWN} WHERE {_scored_cond})"
ORACLES["sample_n"] = f"""SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {_KEY.format(id='id')}, id) AS pos
FROM {_SCORED_LINES}) WHERE pos <= 500"""


def _strat_sql(src_sql: str, target: int, id_col: str = "id", p: str = "") -> str:
    """M1 as chained CTEs (their names start with ``p``): three capped rare passes, a fill pass, negatives."""
    budget, cap = target // 2, max((target // 2) // 3, 1)
    k = _KEY.format(id=id_col)
    lsum = " + ".join(f"coalesce({l}, 0)" for l in LABELS)

    def take(where, n):
        return (f"SELECT {id_col} FROM (SELECT {id_col}, row_number() OVER (ORDER BY {k}, {id_col}) AS rn "
                f"FROM {p}sb WHERE {where}) WHERE rn <= {n}")
    return f"""
{p}sb AS (SELECT * FROM {src_sql}),
{p}p1 AS ({take('threat = 1', cap)}),
{p}p2 AS ({take(f'severe_toxic = 1 AND {id_col} NOT IN (SELECT {id_col} FROM {p}p1)', cap)}),
{p}p3 AS ({take(f'identity_hate = 1 AND {id_col} NOT IN (SELECT {id_col} FROM {p}p1 UNION ALL SELECT {id_col} FROM {p}p2)', cap)}),
{p}rare AS (SELECT * FROM {p}p1 UNION ALL SELECT * FROM {p}p2 UNION ALL SELECT * FROM {p}p3),
{p}fill AS ({take(f'({lsum}) > 0 AND {id_col} NOT IN (SELECT {id_col} FROM {p}rare)', f'greatest({budget} - (SELECT count(*) FROM {p}rare), 0)')}),
{p}picked AS (SELECT * FROM {p}rare UNION ALL SELECT * FROM {p}fill),
{p}neg AS ({take(f'({lsum}) = 0 AND {id_col} NOT IN (SELECT {id_col} FROM {p}picked)', f'(SELECT count(*) FROM {p}picked)')}),
{p}chosen AS (SELECT * FROM {p}picked UNION ALL SELECT * FROM {p}neg),
{p}strat AS (SELECT * FROM (SELECT {p}sb.*, row_number() OVER (ORDER BY {k}, {p}sb.{id_col}) AS pos
          FROM {p}sb WHERE {id_col} IN (SELECT {id_col} FROM {p}chosen)) WHERE pos <= {target})"""


ORACLES["stratified_sample"] = "WITH " + _strat_sql(_SCORED_LINES, 3000) + "\nSELECT * FROM strat"


def _split_sql(part_sql: str, id_col: str) -> str:
    k = _KEY.format(id=id_col)
    return f"""(SELECT p.*, CASE WHEN pos <= n_train THEN 'train' WHEN pos <= n_train + n_val THEN 'validation'
            ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (ORDER BY {k}, {id_col}) AS pos FROM {part_sql}) p,
       (SELECT n_train, CAST(round_even(0.5 * (n - n_train), 0) AS BIGINT) AS n_val
        FROM (SELECT count(*) AS n, CAST(round_even(0.8 * count(*), 0) AS BIGINT) AS n_train FROM {part_sql})) s)"""


ORACLES["split_assign"] = f"SELECT doc_id, pos, split FROM {_split_sql(f'(SELECT doc_id FROM {S.ANNOTATED})', 'doc_id')}"

_CV_LONG = " UNION ALL ".join(f"SELECT doc_id, '{l}' AS label, {l} AS y FROM {_SCORED}" for l in LABELS)
ORACLES["cv_folds"] = f"""
SELECT doc_id, label, y, CAST((row_number() OVER (PARTITION BY label, y ORDER BY {_KEY.format(id='doc_id')}, doc_id) - 1) % 3 AS INTEGER) AS fold
FROM ({_CV_LONG})"""

_TR = S.strip("replace(substr(coalesce(comment_text, ''), 1, 400), chr(10), ' ')")
_DRAWS = {"train": (3000, "TRUE"), "validation": (500, "TRUE"), "test": (500, _scored_cond)}
_TRAIN_COLS = f"comment_text_en, comment_text_sn, {', '.join(LABELS)}, source"
_SILVER = "WITH " + ",".join(_strat_sql(f"(SELECT * FROM {_DRAWN} WHERE given = '{g}' AND {c})", n, "id", f"{g}_")
                             for g, (n, c) in _DRAWS.items()) + ",\nsilver AS (" + " UNION ALL ".join(
    f"SELECT id, '{g}' AS split, pos, {_TR} AS comment_text_en, {_TR} AS comment_text_sn, {', '.join(LABELS)}, 'mt_silver' AS source FROM {g}_strat"
    for g in _DRAWS) + ")"
ORACLES["silver_split"] = _SILVER + "\nSELECT * FROM silver"

_CLEAN = f"""(SELECT conv_id * 1000 + turn AS id, '' AS comment_text_en, text AS comment_text_sn,
   {', '.join(f'0 AS {l}' for l in LABELS)}, 'native_conversational_clean' AS source FROM conversations)"""
_NATIVE_PARTS = f"""
  SELECT split, 'native:' || CAST(doc_id AS VARCHAR) AS key, {_TRAIN_COLS} FROM {_split_sql(_NATIVE, 'doc_id')}
  UNION ALL
  SELECT split, 'clean:' || CAST(id AS VARCHAR) AS key, {_TRAIN_COLS} FROM {_split_sql(_CLEAN, 'id')}
  UNION ALL
  SELECT split, 'custom:' || CAST(doc_id AS VARCHAR) AS key, {_TRAIN_COLS} FROM {_split_sql(_CUSTOM, 'doc_id')}"""
_MERGED = _SILVER + f""",
merged AS (
  SELECT split, 'silver:' || CAST(id AS VARCHAR) AS key, {_TRAIN_COLS} FROM silver WHERE split <> 'test'
  UNION ALL
  SELECT CASE WHEN split = 'test' THEN 'native_test' ELSE split END AS split, key, {_TRAIN_COLS} FROM ({_NATIVE_PARTS})),
placed AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5('42:' || key), key) AS pos FROM merged)"""
ORACLES["merge_sources"] = _MERGED + "\nSELECT * FROM placed WHERE split <> 'native_test'"
ORACLES["native_test"] = _MERGED + "\nSELECT * FROM placed WHERE split = 'native_test'"
ORACLES["source_counts"] = _MERGED + f"""
SELECT split, source, count(*) AS n, {', '.join(f'CAST(sum({l}) AS BIGINT) AS {l}' for l in LABELS)}
FROM merged GROUP BY ROLLUP (split, source)"""


# ------------------------------------------------------------ evaluation
_LOWCT = "lower(coalesce(comment_text, ''))"
_PA_SQL = ", ".join(f"{S.fixture_score(l, 'doc_id')} AS pa_{l}" for l in LABELS)
_PB_SQL = ", ".join(f"{S.marker_score(l, _LOWCT, lx.EN_MARKERS)} AS pb_{l}" for l in LABELS)
_EV = (f"(SELECT doc_id, comment_text, {', '.join(LABELS)}, {_PA_SQL}, {_PB_SQL} "
       f"FROM {S.comment_table()} WHERE {_scored_cond})")


def _div(num, den):
    return f"CASE WHEN ({den}) = 0 THEN CAST(0.0 AS DOUBLE) ELSE CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) END"


def _conf_sql(src, pfx="pa_", by=""):
    sel_by = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    return " UNION ALL ".join(
        f"SELECT {sel_by}'{l}' AS label, count(*) FILTER (WHERE {l} = 1 AND {pfx}{l} >= 0.5) AS tp, "
        f"count(*) FILTER (WHERE {l} <> 1 AND {pfx}{l} >= 0.5) AS fp, "
        f"count(*) FILTER (WHERE {l} = 1 AND NOT ({pfx}{l} >= 0.5)) AS fn, "
        f"count(*) FILTER (WHERE {l} <> 1 AND NOT ({pfx}{l} >= 0.5)) AS tn FROM {src}{grp}" for l in LABELS)


ORACLES["confusion"] = f"SELECT *, tp + fn AS support FROM ({_conf_sql(_EV)})"


def _metrics_sql(conf):
    return (f"SELECT label, tp + fn AS support, round({_div('tp', 'tp + fp')}, 6) AS precision, "
            f"round({_div('tp', 'tp + fn')}, 6) AS recall, round({_div('2 * tp', '2 * tp + fp + fn')}, 6) AS f1 "
            f"FROM ({conf})")


ORACLES["label_metrics"] = _metrics_sql(_conf_sql(_EV))


def _overall_sql(src, pfx="pa_", by=None, rnd=True):
    """Macro (all / tested) and micro F1, Hamming loss, subset accuracy."""
    by_sel = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    wrong = " + ".join(f"CAST(({l} = 1) <> ({pfx}{l} >= 0.5) AS INTEGER)" for l in LABELS)
    cnt = ", ".join(
        f"count(*) FILTER (WHERE {l} = 1 AND {pfx}{l} >= 0.5) AS tp_{l}, "
        f"count(*) FILTER (WHERE {l} <> 1 AND {pfx}{l} >= 0.5) AS fp_{l}, "
        f"count(*) FILTER (WHERE {l} = 1 AND NOT ({pfx}{l} >= 0.5)) AS fn_{l}" for l in LABELS)
    f1 = {l: _div(f"2 * tp_{l}", f"2 * tp_{l} + fp_{l} + fn_{l}") for l in LABELS}
    sup = {l: f"(tp_{l} + fn_{l})" for l in LABELS}
    tested_n = " + ".join(f"CASE WHEN {sup[l]} > 0 THEN 1 ELSE 0 END" for l in LABELS)
    tested_sum = " + ".join(f"CASE WHEN {sup[l]} > 0 THEN {f1[l]} ELSE 0.0 END" for l in LABELS)
    tp = " + ".join(f"tp_{l}" for l in LABELS)
    fp = " + ".join(f"fp_{l}" for l in LABELS)
    fn = " + ".join(f"fn_{l}" for l in LABELS)
    r = (lambda x: f"round({x}, 6)") if rnd else (lambda x: x)
    return f"""SELECT {by_sel}n, {r(f"({' + '.join(f1.values())}) / 6.0")} AS macro_f1,
  {r(f"CASE WHEN ({tested_n}) > 0 THEN ({tested_sum}) / ({tested_n}) END")} AS macro_f1_tested,
  {r(_div(f'2 * ({tp})', f'2 * ({tp}) + ({fp}) + ({fn})'))} AS micro_f1,
  {r(_div('wrong', 'n * 6'))} AS hamming_loss, {r(_div('exact', 'n'))} AS subset_accuracy
FROM (SELECT {by_sel}count(*) AS n, sum({wrong}) AS wrong, count(*) FILTER (WHERE ({wrong}) = 0) AS exact, {cnt}
      FROM {src}{grp})"""


ORACLES["macro_micro"] = _overall_sql(_EV)


def _auc_sql(long_sql, keys):
    """Exact AUC with ties 1/2 over (keys, y, p) via cumulative negatives."""
    ks = ", ".join(keys)
    kp = f"{ks}, " if keys else ""
    part = f"PARTITION BY {ks} " if keys else ""
    grp = f" GROUP BY {ks}" if keys else ""
    return f"""SELECT {kp}n_pos, n_neg,
  CASE WHEN n_pos > 0 AND n_neg > 0 THEN round(u / (n_pos * n_neg), 6) END AS roc_auc
FROM (SELECT {kp}sum(pos) AS n_pos, sum(neg) AS n_neg, sum(pos * (nb + 0.5 * neg)) AS u
      FROM (SELECT *, coalesce(sum(neg) OVER ({part}ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb
            FROM (SELECT {kp}p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg
                  FROM ({long_sql}) GROUP BY {kp}p)){grp})"""


def _long_sql(src, pfx="pa_"):
    return " UNION ALL ".join(f"SELECT '{l}' AS label, {l} AS y, {pfx}{l} AS p FROM {src}" for l in LABELS)


ORACLES["roc_auc"] = _auc_sql(_long_sql(_EV), ["label"])


def _auc_overall_sql(src):
    return f"""SELECT (SELECT CASE WHEN count(roc_auc) = 6 THEN round(avg(roc_auc_raw), 6) END
        FROM (SELECT roc_auc, CASE WHEN n_pos > 0 AND n_neg > 0 THEN u / (n_pos * n_neg) END AS roc_auc_raw
              FROM ({_auc_sql(_long_sql(src), ['label']).replace('round(u / (n_pos * n_neg), 6) END AS roc_auc', 'u / (n_pos * n_neg) END AS roc_auc').replace('SELECT label, n_pos, n_neg,', 'SELECT label, n_pos, n_neg, u,')}))) AS macro_roc_auc,
       (SELECT roc_auc FROM ({_auc_sql(f'SELECT y, p FROM ({_long_sql(src)})', [])})) AS micro_roc_auc"""


ORACLES["roc_auc_overall"] = _auc_overall_sql(_EV)

_EV_LINES = (f"(SELECT id, {', '.join(LABELS)}, {', '.join(f'{S.fixture_score(l, "id")} AS pa_{l}' for l in LABELS)} "
             f"FROM {_DRAWN} WHERE {_scored_cond})")
_BENCH_SRC = f"(SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {_KEY.format(id='id')}, id) AS pos FROM {_EV_LINES}) WHERE pos <= 500)"
ORACLES["benchmark_eval"] = f"""
SELECT o.n AS n_test, o.macro_f1, o.micro_f1, o.hamming_loss, o.subset_accuracy, a.macro_roc_auc, a.micro_roc_auc
FROM ({_overall_sql(_BENCH_SRC)}) o, ({_auc_overall_sql(_BENCH_SRC)}) a"""

_GL = S.category_labels_sql("category", "severity", "label = 'toxic'")
_GOLD = f"""(SELECT doc_id,
   list_filter([{', '.join(f"CASE WHEN {_GL[l]} = 1 THEN '{l}' END" for l in LABELS)}], lambda x: x IS NOT NULL) AS expected,
   list_filter([{', '.join(f"CASE WHEN {S.marker_score(l, "lower(coalesce(text, ''))", lx.EN_MARKERS)} >= 0.5 THEN '{l}' END" for l in LABELS)}], lambda x: x IS NOT NULL) AS predicted,
   category IN ('benign_conversational', 'literal_or_metalinguistic') AS known_limitation
 FROM {S.ANNOTATED})"""
_GOLD_WIDE = f"""(SELECT CASE WHEN coalesce(known_limitation, FALSE) THEN 'known_limitations' ELSE 'gating' END AS slice,
   list_sort(expected) = list_sort(predicted) AS match,
   {', '.join(f"CAST(list_contains(expected, '{l}') AS INTEGER) AS {l}" for l in LABELS)},
   {', '.join(f"CASE WHEN list_contains(predicted, '{l}') THEN 1.0 ELSE 0.0 END AS pg_{l}" for l in LABELS)}
 FROM {_GOLD})"""
_GOLDEN_SQL = f"""SELECT o.slice, o.n AS n_examples, e.exact_match_rate, o.macro_f1_tested AS macro_f1
FROM ({_overall_sql(_GOLD_WIDE, 'pg_', 'slice')}) o
JOIN (SELECT slice, round(avg(CAST(match AS DOUBLE)), 6) AS exact_match_rate FROM {_GOLD_WIDE} GROUP BY slice) e USING (slice)"""
ORACLES["golden_eval"] = _GOLDEN_SQL

_GOLD_LINES = f"""(SELECT id,
   list_filter([{', '.join(f"CASE WHEN {l} = 1 THEN '{l}' END" for l in LABELS)}], lambda x: x IS NOT NULL) AS expected,
   list_filter([{', '.join(f"CASE WHEN {S.marker_score(l, "lower(coalesce(text, ''))", lx.EN_MARKERS)} >= 0.5 THEN '{l}' END" for l in LABELS)}], lambda x: x IS NOT NULL) AS predicted,
   {S.digits_of('drawn', 'id', 9)} < 3 AS known
 FROM {_DRAWN} JOIN (SELECT id, text FROM {_MIXED}) USING (id) WHERE {_scored_cond})"""
ORACLES["golden_mismatches"] = f"""
WITH g AS (SELECT *, CASE WHEN known THEN 'known_limitations' ELSE 'gating' END AS slice FROM {_GOLD_LINES}),
d AS (
  SELECT *, 'missing' AS kind, unnest(list_filter(expected, lambda x: NOT list_contains(predicted, x))) AS label FROM g
  UNION ALL
  SELECT *, 'extra' AS kind, unnest(list_filter(predicted, lambda x: NOT list_contains(expected, x))) AS label FROM g
  UNION ALL
  SELECT *, 'now_passes' AS kind, NULL AS label FROM g WHERE known AND list_sort(expected) = list_sort(predicted))
SELECT id, slice, kind, label, array_to_string(list_sort(expected), ',') AS expected, array_to_string(list_sort(predicted), ',') AS predicted,
       CASE WHEN known THEN 'documented as ' || CAST(id AS VARCHAR) END AS limitation_note FROM d"""

_TJ = S.category_labels_sql("category", "severity", "label = 'toxic'")
ORACLES["truth_join"] = f"""
WITH t0 AS (SELECT doc_id, {', '.join(f'{_TJ[l]} AS {l}' for l in LABELS)} FROM {S.ANNOTATED} WHERE doc_id % 7 <> 3),
t AS (SELECT * FROM t0 UNION ALL SELECT * FROM t0 WHERE doc_id % 11 = 5),
p0 AS (SELECT doc_id, {_PA_SQL} FROM documents WHERE doc_id % 5 <> 2),
p AS (SELECT * FROM p0 UNION ALL SELECT * FROM p0 WHERE doc_id % 13 = 4),
ids AS (SELECT doc_id, sum(t) AS nt, sum(p) AS np FROM (SELECT doc_id, 1 AS t, 0 AS p FROM t UNION ALL SELECT doc_id, 0, 1 FROM p) GROUP BY doc_id),
s AS (SELECT doc_id, CASE WHEN nt > 1 OR np > 1 THEN 'repeated' WHEN np = 0 THEN 'truth_only' WHEN nt = 0 THEN 'pred_only' ELSE 'matched' END AS status FROM ids),
m AS (SELECT * FROM s JOIN t USING (doc_id) JOIN p USING (doc_id) WHERE status = 'matched'),
c AS ({_conf_sql('m')})
SELECT 'coverage' AS part, status AS name, NULL AS label, count(*) AS n FROM s GROUP BY status
UNION ALL SELECT 'confusion', 'tp', label, tp FROM c UNION ALL SELECT 'confusion', 'fp', label, fp FROM c
UNION ALL SELECT 'confusion', 'fn', label, fn FROM c UNION ALL SELECT 'confusion', 'tn', label, tn FROM c"""

_SLICED = f"""(SELECT id, {', '.join(LABELS)}, {', '.join(f'pa_{l}' for l in LABELS)},
   CASE WHEN {S.digits_of('drawn', 'id', 8)} = 9 THEN 'golden' ELSE 'mt_silver' END AS slice, {S.digits_of('drawn', 'id', 9)} >= 3 AS gates FROM {_EV_LINES}
 UNION ALL SELECT doc_id, {', '.join(LABELS)}, {', '.join(f'pa_{l}' for l in LABELS)}, 'native', TRUE FROM {_EV})"""
_SLICED_OK = f"(SELECT * FROM {_SLICED} WHERE slice <> 'golden' OR gates)"
ORACLES["slice_report"] = f"""
SELECT w.slice, CASE WHEN n.n IS NULL THEN 'skipped' ELSE 'scored' END AS status, coalesce(n.n, 0) AS n_examples, coalesce(o.n, 0) AS n_scored,
       o.macro_f1_tested AS macro_f1, o.micro_f1, o.hamming_loss, o.subset_accuracy
FROM (VALUES ('mt_silver'), ('native'), ('golden'), ('native_social'), ('custom_reviewed')) w(slice)
LEFT JOIN (SELECT slice, count(*) AS n FROM {_SLICED} GROUP BY slice) n USING (slice)
LEFT JOIN ({_overall_sql(_SLICED_OK, 'pa_', 'slice')}) o USING (slice)"""


def _report_sql(pfx: str) -> str:
    """Long form of a report: per-label metrics and overall ones."""
    conf = _conf_sql(_EV, pfx)
    per = (f"SELECT label, tp + fn AS support, {_div('tp', 'tp + fp')} AS precision, {_div('tp', 'tp + fn')} AS recall, "
           f"{_div('2 * tp', '2 * tp + fp + fn')} AS f1 FROM ({conf})")
    over = _overall_sql(_EV, pfx, rnd=False)
    longs = [f"SELECT label, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM ({per})" for m in ("precision", "recall", "f1", "support")]
    longs += [f"SELECT 'overall', '{m}', CAST({c} AS DOUBLE) FROM ({over})"
              for m, c in (("macro_f1", "macro_f1"), ("micro_f1", "micro_f1"), ("hamming_loss", "hamming_loss"),
                           ("subset_accuracy", "subset_accuracy"), ("n_test", "n"))]
    return " UNION ALL ".join(longs)


ORACLES["report_compare"] = f"""
SELECT a.label, a.metric, round(a.value, 6) AS value, round(b.value, 6) AS baseline, round(a.value - b.value, 6) AS delta
FROM ({_report_sql('pa_')}) a LEFT JOIN (SELECT * FROM ({_report_sql('pb_')}) WHERE label <> 'threat') b USING (label, metric)"""

ORACLES["model_compare"] = f"""
SELECT a.label, a.f1, b.f1 AS baseline_f1, round(a.f1_raw - b.f1_raw, 6) AS delta
FROM (SELECT label, round(f1r, 6) AS f1, f1r AS f1_raw FROM (SELECT label, {_div('2 * tp', '2 * tp + fp + fn')} AS f1r FROM ({_conf_sql(_EV, 'pa_')}))) a
LEFT JOIN (SELECT label, round(f1r, 6) AS f1, f1r AS f1_raw FROM (SELECT label, {_div('2 * tp', '2 * tp + fp + fn')} AS f1r FROM ({_conf_sql(_EV, 'pb_')}))) b
USING (label)"""

ORACLES["eval_gate"] = f"""
WITH g AS (SELECT exact_match_rate, macro_f1 AS golden_macro_f1 FROM ({_GOLDEN_SQL}) WHERE slice = 'gating'),
n AS (SELECT macro_f1 AS new_macro_f1 FROM ({_overall_sql(_EV, 'pa_', rnd=False)})),
b AS (SELECT macro_f1 AS baseline_macro_f1 FROM ({_overall_sql(_EV, 'pb_', rnd=False)}))
SELECT exact_match_rate, golden_macro_f1, round(new_macro_f1, 6) AS new_macro_f1, round(baseline_macro_f1, 6) AS baseline_macro_f1,
  coalesce(exact_match_rate >= 0.75, FALSE) AND coalesce(golden_macro_f1 >= 0.75, FALSE)
  AND (baseline_macro_f1 IS NULL OR new_macro_f1 > baseline_macro_f1) AS passed
FROM g, n, b"""

_EV_SLICE = f"(SELECT e.*, d.lang AS slice FROM {_EV} e JOIN documents d USING (doc_id))"
ORACLES["slice_metrics"] = f"""SELECT slice, n AS n_examples, macro_f1_tested AS macro_f1, micro_f1
FROM ({_overall_sql(_EV_SLICE, 'pa_', 'slice')})"""

_CW_LONG = " UNION ALL ".join(f"SELECT '{l}' AS label, {l} AS y FROM {_SCORED}" for l in LABELS)
ORACLES["class_weights"] = f"""
SELECT label, n, n_pos, n_neg, round(CASE WHEN n_pos > 0 THEN n / (2.0 * n_pos) END, 6) AS w_pos,
       round(CASE WHEN n_neg > 0 THEN n / (2.0 * n_neg) END, 6) AS w_neg
FROM (SELECT label, count(*) AS n, count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y = 0) AS n_neg
      FROM ({_CW_LONG}) GROUP BY label)"""


# ------------------------------------------------------------ features
_WORDS = f"list_filter(string_split({S.clean_text('text')}, ' '), lambda x: length(x) > 0)"
_VOCAB = f"""(SELECT word, count, CAST(rn + 1 AS INTEGER) AS index
 FROM (SELECT word, count, row_number() OVER (ORDER BY count DESC, first_doc, first_pos, word) AS rn
       FROM (SELECT word, count(*) AS count, arg_min(doc_id, doc_id * 1000000 + pos) AS first_doc,
                    arg_min(pos, doc_id * 1000000 + pos) AS first_pos
             FROM (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS word
                   FROM (SELECT doc_id, {_WORDS} AS w FROM documents))
             GROUP BY word))
 WHERE rn <= 19998)"""
ORACLES["vocab"] = f"SELECT * FROM {_VOCAB}"
ORACLES["encoded"] = f"""
WITH v AS {_VOCAB},
d AS (SELECT doc_id, list_slice({_WORDS}, 1, 150) AS w FROM documents),
e AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
s AS (SELECT doc_id, list(coalesce(v.index, 1) ORDER BY i) AS ids FROM e LEFT JOIN v USING (word) GROUP BY doc_id)
SELECT d.doc_id, array_to_string(coalesce(ids, []::INTEGER[]) || list_transform(range(150 - len(coalesce(ids, []::INTEGER[]))), lambda x: 0), ',') AS sequence
FROM documents d LEFT JOIN s USING (doc_id)"""

_WTOK = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}')"
_WGRAMS = f"(SELECT doc_id, t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) AS grams FROM (SELECT doc_id, {_WTOK} AS t FROM documents))"
_CWORDS = f"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[{S.WS}]+'), lambda w: length(w) > 0)"
_CGRAMS = f"""(SELECT doc_id, flatten(list_transform(ws, lambda w: flatten(list_transform(
    range(3, least(5, length(w) + 2) + 1),
    lambda n: list_transform(range(0, length(w) + 2 - n + 1), lambda o: substr(' ' || w || ' ', o + 1, n))))))
  AS grams FROM (SELECT doc_id, {_CWORDS} AS ws FROM documents))"""


def _tf_sql(grams):
    return f"(SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(grams) AS term FROM {grams}) GROUP BY doc_id, term)"


def _df_sql(grams, min_df):
    return f"(SELECT term, count(*) AS df FROM {_tf_sql(grams)} GROUP BY term HAVING count(*) >= {min_df})"


ORACLES["doc_freq"] = (f"SELECT 'word' AS block, term, df FROM {_df_sql(_WGRAMS, 2)} UNION ALL "
                       f"SELECT 'char' AS block, term, df FROM {_df_sql(_CGRAMS, 3)}")


def _tfidf_sql(grams, min_df):
    return f"""
WITH tf AS {_tf_sql(grams)}, n AS (SELECT count(*) AS n FROM documents),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= {min_df}),
w AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1.0 + n) / (1.0 + df)) + 1) AS w FROM tf JOIN df USING (term), n)
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w"""


ORACLES["tfidf_word"] = _tfidf_sql(_WGRAMS, 2)
ORACLES["tfidf_char"] = _tfidf_sql(_CGRAMS, 3)
def _tfidf_unseen_sql(grams, min_df, tag):
    train = f"(SELECT * FROM {_tf_sql(grams)} WHERE doc_id % 10 < 8)"
    return f"""
SELECT doc_id, '{tag}:' || term AS feature, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight
FROM (SELECT doc_id, term, (1 + ln(tf)) * (ln((1.0 + n) / (1.0 + df)) + 1) AS w
      FROM (SELECT * FROM {_tf_sql(grams)} WHERE doc_id % 10 >= 8)
      JOIN (SELECT term, count(*) AS df FROM {train} GROUP BY term HAVING count(*) >= {min_df}) USING (term),
      (SELECT count(*) AS n FROM documents WHERE doc_id % 10 < 8))"""


ORACLES["tfidf_validation"] = _tfidf_unseen_sql(_WGRAMS, 2, "w") + " UNION ALL " + _tfidf_unseen_sql(_CGRAMS, 3, "c")
ORACLES["tfidf_union"] = f"""
WITH n AS (SELECT count(*) AS n FROM documents),
v AS (SELECT 'w:' || term AS feature, df FROM {_df_sql(_WGRAMS, 2)} UNION ALL SELECT 'c:' || term AS feature, df FROM {_df_sql(_CGRAMS, 3)})
SELECT feature, CAST(row_number() OVER (ORDER BY md5(feature), feature) - 1 AS INTEGER) AS idx,
       round(ln((1.0 + n) / (1.0 + df)) + 1, 6) AS idf FROM v, n"""


# ------------------------------------------------------------ presentation & streaming
ORACLES["moderate_stream"] = ORACLES["moderate_auto"]
_RANK_ITEMS = ", ".join(
    f"{{'neg': -({S.fixture_score(l, 'doc_id')}), 'i': {i}, 'label': '{l}', "
    f"'pct': least(100, CAST(floor({S.fixture_score(l, 'doc_id')} * 100 + 0.5) AS INTEGER))}}"
    for i, l in enumerate(LABELS))
ORACLES["ranked_scores"] = f"""
SELECT doc_id, array_to_string(list_transform(list_sort([{_RANK_ITEMS}]), lambda x: x.label || ':' || CAST(x.pct AS VARCHAR)), ',') AS ranked
FROM documents"""
ORACLES["verdict_text"] = _moderated_sql("documents", "doc_id") + """
SELECT doc_id,
  CASE WHEN len(fl_list) > 0 THEN '[' || upper(language) || '] Flagged: ' || array_to_string(fl_list, ', ')
       ELSE '[' || upper(language) || '] No toxicity detected' END AS verdict,
  CASE WHEN len(fl_list) > 0 THEN array_to_string(list_transform(fl_list, lambda x: regexp_replace(x, '_', ' ')), ' ')
       ELSE 'none' END AS tags
FROM fl"""
