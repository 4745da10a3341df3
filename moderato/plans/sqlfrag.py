"""DuckDB SQL fragments that restate the Column builders for the oracles."""

from __future__ import annotations

from moderato.functions import lexicon as lx
from moderato.functions.language import CLUSTER_PATTERN
from moderato.functions.lexicon import VALID_CATEGORIES
from moderato.schema import LABELS

# Java (?U)\S restated for RE2: anything but White_Space.
NON_SPACE = r"[^\t\n\x0b\f\r\x{85}\pZ]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(words) -> str:
    return "(" + ", ".join(q(w) for w in dict.fromkeys(words)) + ")"


def tokens(expr: str) -> str:
    return f"regexp_extract_all(lower(coalesce({expr}, '')), '[a-z'']+')"


def scoreable(expr: str) -> str:
    return f"regexp_matches(coalesce({expr}, ''), '{NON_SPACE}')"


def en_evidence(toks: str) -> str:
    return f"CAST(2.0 AS DOUBLE) * len(list_filter({toks}, lambda t: t IN {in_list(lx.EN_WORDS)}))"


def sn_evidence(toks: str) -> str:
    sn = in_list(lx.SN_WORDS)
    return (f"(CAST(3.0 AS DOUBLE) * len(list_filter({toks}, lambda t: t IN {sn}))"
            f" + CAST(1.0 AS DOUBLE) * len(list_filter({toks}, lambda t: t NOT IN {sn} AND regexp_matches(t, {q(lx.SN_PREFIX_PATTERN)})))"
            f" + CAST(0.5 AS DOUBLE) * len(list_filter({toks}, lambda t: regexp_matches(t, {q(CLUSTER_PATTERN)}))))")


def decide(en: str, sn: str, default: str = "'en'") -> str:
    return f"CASE WHEN {sn} > {en} AND {sn} >= 1 THEN 'sn' WHEN {en} > {sn} THEN 'en' ELSE {default} END"


def marker_hit(low: str, markers) -> str:
    return "(" + " OR ".join(f"contains({low}, {q(m)})" for m in markers) + ")"


def d(x) -> str:
    """A DOUBLE literal (DuckDB would otherwise type 0.01 as DECIMAL)."""
    return f"CAST({x!r} AS DOUBLE)"


def marker_score(label: str, low: str, markers, target="toxic", other=lx.MARKER_MISS) -> str:
    if label != target:
        return d(other)
    return f"CASE WHEN {marker_hit(low, markers)} THEN {d(lx.MARKER_HIT)} ELSE {d(lx.MARKER_MISS)} END"


def whitelisted(toks: str) -> str:
    benign = in_list(lx.BENIGN_TOKENS)
    return (f"(len({toks}) BETWEEN 1 AND {lx.WHITELIST_MAX_TOKENS}"
            f" AND NOT list_bool_or(list_transform({toks}, lambda t: t IN {in_list(lx.KNOWN_TOXIC_TOKENS)}))"
            f" AND list_bool_or(list_transform({toks}, lambda t: t IN {benign}))"
            f" AND list_bool_and(list_transform({toks}, lambda t: t IN {benign} OR length(t) <= {lx.WHITELIST_SHORT_TOKEN})))")


def floor(label: str, toks: str) -> str:
    entries = [(tok, m[label]) for tok, m in lx.SLUR_FLOORS.items() if label in m]
    if not entries:
        return d(0.0)
    case = "CASE t " + " ".join(f"WHEN {q(tok)} THEN {d(v)}" for tok, v in entries) + f" ELSE {d(0.0)} END"
    return f"coalesce(list_max(list_transform({toks}, lambda t: {case})), {d(0.0)})"


def shona_adjust(score: str, label: str, toks: str) -> str:
    return (f"CASE WHEN {whitelisted(toks)} THEN least({score}, {d(lx.WHITELIST_CAP)})"
            f" ELSE greatest({score}, {floor(label, toks)}) END")


def flagged(score_cols: dict, thr: dict, scoreable_expr: str | None = None) -> str:
    items = ", ".join(f"CASE WHEN {score_cols[l]} >= {thr[l]} THEN {q(l)} END" for l in LABELS)
    lst = f"list_filter([{items}], lambda x: x IS NOT NULL)"
    if scoreable_expr:
        lst = f"CASE WHEN {scoreable_expr} THEN {lst} ELSE []::VARCHAR[] END"
    return lst


def category_of(id_expr: str) -> str:
    arr = "[" + ", ".join(q(c) for c in VALID_CATEGORIES) + "]"
    return f"{arr}[({id_expr} % {len(VALID_CATEGORIES)}) + 1]"


def fixture_score(label: str, id_expr: str) -> str:
    return f"(('0x' || substr(md5({q(label)} || ':' || CAST({id_expr} AS VARCHAR)), 1, 4))::INTEGER / 65535.0)"


ANNOTATED = f"""(
  SELECT d.doc_id, d.text, d.lang, d.source, l.quality,
         CASE WHEN l.toxic = 1 THEN 'toxic' ELSE 'non-toxic' END AS label,
         {category_of('d.doc_id')} AS category,
         CAST(CASE WHEN l.toxic = 1 THEN d.doc_id % 5 ELSE 0 END AS INTEGER) AS severity
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def category_labels_sql(cat: str, sev: str, is_toxic: str) -> dict:
    out = {}
    for lab in LABELS:
        cats = [c for c, labs in lx.CATEGORY_LABELS.items() if lab in labs]
        extra = (lx.SEV4_ADDS_OBSCENE if lab == "obscene" else []) + (
            lx.SEV4_ADDS_SEVERE_TOXIC if lab == "severe_toxic" else [])
        cond = "TRUE" if lab == "toxic" else f"coalesce({cat} IN {in_list(cats)}, FALSE)"
        if extra:
            cond = f"({cond} OR (coalesce({sev} = 4, FALSE) AND coalesce({cat} IN {in_list(extra)}, FALSE)))"
        out[lab] = f"CAST(CASE WHEN coalesce({is_toxic}, FALSE) AND {cond} THEN 1 ELSE 0 END AS INTEGER)"
    return out


WS = r"\t\n\x0b\f\r\x{85}\pZ"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def clean_text(expr: str) -> str:
    t = f"replace(replace(lower(coalesce({expr}, '')), chr(10), ' '), chr(9), ' ')"
    t = f"regexp_replace({t}, {q(r'https?://\S+|www\.\S+')}, ' ', 'g')"
    t = f"regexp_replace({t}, {q(r'\b(?:\d{1,3}\.){3}\d{1,3}\b')}, ' ', 'g')"
    t = f"regexp_replace({t}, {q(r"[^a-z\s']")}, ' ', 'g')"
    t = f"regexp_replace({t}, {q(r'\s+')}, ' ', 'g')"
    return f"trim({t})"


def comment_table() -> str:
    """D1 view: P4 labels, -1 on quality-0 rows."""
    labs = category_labels_sql("category", "severity", "label = 'toxic'")
    cols = ", ".join(f"CASE WHEN quality = 0 THEN -1 ELSE {labs[l]} END AS {l}" for l in LABELS)
    return f"(SELECT doc_id, text AS comment_text, {cols} FROM {ANNOTATED})"


def fixture_scores_cols(id_expr: str, prefix: str = "s_") -> str:
    return ", ".join(f"{fixture_score(l, id_expr)} AS {prefix}{l}" for l in LABELS)


def digits_of(tag: str, id_expr: str, first: int, n: int = 1) -> str:
    return f"(('0x' || substr(md5('{tag}:' || CAST({id_expr} AS VARCHAR)), {first + 1}, {n}))::INTEGER)"


LINES = f"""(
  SELECT doc_id * 1000000 + i - 1 AS id, lines[i] AS text, lang, source
  FROM (SELECT doc_id, lang, source, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {strip('x')}),
                                                 lambda x: length(x) > 0) AS lines FROM documents),
       LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i))"""


def mixed() -> str:
    from moderato.sources.fixtures import MIXED, MIXED_OF
    ways = []
    for v, (keep, phrases) in enumerate(MIXED):
        if phrases is None:
            new = "NULL"
        else:
            listed = "[" + ", ".join(q(p).replace("\t", "' || chr(9) || '").replace("\n", "' || chr(10) || '") for p in phrases) + "]"
            new = f"{listed}[(h // {MIXED_OF}) % {len(phrases)} + 1]"
            new = f"text || ' ' || {new}" if keep else new
        ways.append(f"WHEN {v} THEN {new}")
    return (f"(SELECT id, CASE h % {MIXED_OF} {' '.join(ways)} ELSE text END AS text, lang, source "
            f"FROM (SELECT *, {digits_of('mix', 'id', 0, 4)} AS h FROM {LINES}))")


def drawn() -> str:
    from moderato.sources.fixtures import DRAWN_RATES
    digit = lambda i: digits_of("drawn", "id", i)
    labs = ", ".join(f"CASE WHEN {digit(7)} = 0 THEN -1 ELSE CAST({digit(j)} < {r} AS INTEGER) END AS {l}"
                     for j, (l, r) in enumerate(zip(LABELS, DRAWN_RATES, strict=True)))
    return (f"(SELECT id, text AS comment_text, {labs}, CASE WHEN {digit(8)} < 2 THEN 'validation' WHEN {digit(8)} < 4 THEN 'test' "
            f"ELSE 'train' END AS given FROM {LINES})")


def raw_annotated(numeric: bool = True) -> str:
    more = "" if numeric else "WHEN 10 THEN 'x' WHEN 11 THEN NULL WHEN 12 THEN '2f'"
    return f"""(SELECT doc_id, CASE doc_id % 29 WHEN 0 THEN NULL WHEN 9 THEN 'the same text again' ELSE text END AS text,
   CASE doc_id % 29 WHEN 1 THEN 'Toxic' WHEN 2 THEN NULL ELSE label END AS label,
   CASE doc_id % 29 WHEN 3 THEN 'unknown_kind' WHEN 4 THEN NULL ELSE category END AS category,
   CASE doc_id % 29 WHEN 5 THEN '9' WHEN 6 THEN '2.5' WHEN 7 THEN '-1' {more} ELSE severity::VARCHAR END AS severity,
   CASE WHEN doc_id % 29 = 8 THEN NULL ELSE source END AS source_lemma FROM {ANNOTATED})"""


FILED = f"""(SELECT * EXCLUDE (severity),
   CASE WHEN source = 'src2' AND doc_id % 3 = 0 THEN '2x' WHEN source = 'src3' AND doc_id % 5 = 0 THEN '99999999999' ELSE severity::VARCHAR END AS severity,
   CASE WHEN source = 'src0' THEN '/data/native/full.csv'
        WHEN source = 'src1' AND lang = 'en' THEN '/data/native/custom_shona_template.csv'
        WHEN source = 'src1' THEN '/data/' || lang || '/custom_shona_template.csv'
        ELSE '/data/native/' || source || ' ' || coalesce(lang, '') || '.csv' END AS file FROM {ANNOTATED})"""
