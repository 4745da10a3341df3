"""Operator 13: base rules against plain patterns, and what the ledger lets a run leave out."""

import hashlib
import itertools
import os
import random
import re

import pytest

from moderato.llm import secret_rules as sr
from moderato.llm import secret_scan as ss

WORDS = ("".join(f"[{c.upper()}{c}]" for c in w) for w in ("password", "passwd", "secret", "token"))
ASSIGN = re.compile("(" + "|".join(WORDS) + """|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KINDS = ("assign", "access", "hex")


def plain(text):
    """Base spans by the patterns as they are stated."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(KINDS[k], a, b) for a, k, b in sorted(out)]


def some_texts(seed, n):
    rng = random.Random(seed)
    bits = ["password", "PassWd", "secret", "toKen", "api_key", "APIKEY", "paſſword", "toKen", '"', "'", " ", "  ", ":", "=", "AKIA", "0123456789abcdef",
            "ABCDEFGH1234", "hunter22", "x", "é漢\U0001f600", "\n", "-", "."]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(n)]


def watch(file):
    """What finds runs of b and notes the blobs that it reads, and what tells and forgets these."""
    def find(text):
        with open(file, "a") as f:
            f.write(hashlib.sha256(text.encode()).hexdigest() + "\n")
        return [m.span() for m in re.finditer("b+", text)]

    def read():
        out = sorted(open(file).read().split()) if os.path.exists(file) else []
        open(file, "w").close()
        return out
    return find, read


def blob(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def test_rules():
    for text in some_texts(1, 3000):
        got = sorted((a, KINDS.index(r.name), b) for r in sr.BASE for a, b in r.find(text))
        assert [(KINDS[k], a, b) for a, k, b in got] == plain(text)
    found = {r.name: r.find for r in sr.ADDED}
    for name, text, at in [("private_key", "x -----BEGIN RSA PRIVATE KEY-----\nMIIB\n-----END RSA PRIVATE KEY----- y", (2, 68)),
                           ("jwt", "a eyJhbGci.eyJzdWIi.abc_-1 b", (2, 26)), ("code_host", "ghp_" + "a1" * 18, (0, 40)),
                           ("chat", "(xoxb-1234567890-ab)", (1, 19)), ("maps", "AIza" + "Q" * 35, (0, 39)),
                           ("payment", "sk_live_" + "z" * 16, (0, 24)), ("url_login", "https://me:pass@host/", (8, 15))]:
        assert found[name](text) == [at], name
    assert not any(f("plain prose: the key of sk_ and eyJ, ghp_short, https://host/a@b") for f in found.values())


@pytest.mark.parametrize("mark", ["token", "AKIA", "eyJ", "-----BEGIN RSA PRIVATE KEY-----", "a:", "://", "token" + " " * 50, "f" * 31 + "g"])
def test_long_texts_cost_their_length(mark):
    text = mark * (400_000 // len(mark))
    for r in sr.RULES:
        r.find(text)


def test_only_unseen_pairs(spark, tmp_path):
    first, read_first = watch(f"{tmp_path}/first")
    second, read_second = watch(f"{tmp_path}/second")
    rules = (sr.Rule("one", 1, first), sr.Rule("two", 1, second))
    ledger = ss.Ledger(spark, f"{tmp_path}/ledger")
    texts = [f"text bb {i}" for i in range(40)] + ["same b"] * 60 + [None, ""]
    rows = [(i if i % 7 else None, 0, t, "k", 1) for i, t in enumerate(texts)]

    def run(rows, rules):
        df = spark.createDataFrame(rows, "path long, version int, text string, blob string, at int").repartition(6)
        out = ss.scan_versions(df, ledger, rules).collect()
        assert sorted((r.path or -1, r.version, r.blob) for r in out) == sorted((p or -1, v, blob(t)) for p, v, t, _, _ in rows)
        for r in out:
            assert [tuple(f) for f in r.findings] == want(r.blob, rules)
        return read_first(), read_second()

    def want(key, rules):
        text = next(t or "" for t in itertools.chain(texts, more) if blob(t) == key)
        return [(r.name, *m.span()) for m in re.finditer("b+", text) for r in rules]
    more = ["text bb 1", "new bbb", "same b", "new bbb", "older b b"]
    distinct = sorted({blob(t) for t in texts})
    assert run(rows, rules) == (distinct, distinct)           # each blob once, copies and null ids or not
    assert run(rows, rules) == ([], [])                       # nothing is open
    later = [(i, 1, t, "k", 1) for i, t in enumerate(more)]
    unseen = sorted({blob("new bbb"), blob("older b b")})
    assert run(rows + later, rules) == (unseen, unseen)       # history grows by two blobs
    rules = (sr.Rule("one", 2, first), rules[1])
    assert run(rows + later, rules) == (sorted({*distinct, *unseen}), [])   # a new version of one rule reads all, the other nothing
    assert run(later, (rules[1], rules[0])) == ([], [])       # order of rules only orders findings
    assert ledger.pairs.count() == 3 * len({*distinct, *unseen})


def test_lost_run(spark, tmp_path):
    """Findings without their pairs are made again and not told twice."""
    ledger = ss.Ledger(spark, f"{tmp_path}/ledger")
    df = spark.createDataFrame([(1, 0, "AKIA" + "A" * 12), (2, 0, "AKIA" + "A" * 12)], "path long, version int, text string")
    ss.scan_versions(df, ledger).collect()
    lost = ss.Ledger(spark, f"{tmp_path}/second")
    ledger.findings.write.mode("append").parquet(f"{lost.uri}/findings")
    got = ss.scan_versions(df, lost).collect()
    assert [[tuple(f) for f in r.findings] for r in got] == [[("access", 0, 16)]] * 2 and lost.findings.count() == 1


def test_crowded_bitmaps(spark, tmp_path):
    """With far more repeated blobs than bits, all goes the longer way and nothing changes."""
    rows = [(i, 0, f"b {i % 45_000}") for i in range(90_000)] + [(i, 0, f"b {i}") for i in range(90_000, 95_000)]
    df = spark.createDataFrame(rows, "path long, version int, text string").repartition(4)
    find, read = watch(f"{tmp_path}/seen")
    out = ss.scan_versions(df, ss.Ledger(spark, f"{tmp_path}/ledger"), (sr.Rule("b", 1, find),), max_bits=1 << 15)
    assert out.filter("size(findings) = 1").count() == 95_000
    assert read() == sorted({blob(t) for _, _, t in rows})


def test_query(spark, tmp_path):
    texts = [*some_texts(6, 300), None, "", "token=" + "a" * 200_000, "x" * 300_000 + " AKIA" + "Z" * 12]
    texts += texts[:20] * 3
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in ss.op13_secret_scan(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        base = plain(text or "")
        line = [f"{k}:{a}:{b}" for k, a, b in base]
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(s[0] == k for s in base) for k in KINDS)
        assert got[i].base_sha256 == hashlib.sha256(",".join(line).encode()).hexdigest()
        assert [s for s in got[i].spans.split(",") if s.split(":")[0] in KINDS] == line
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert ss.op13_secret_scan(spark, f"{tmp_path}/none").collect() == []
