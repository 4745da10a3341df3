"""Operator 12: the transducer against sorted lists, the audit against plain Python with whole numbers."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from moderato.llm import divergence as dv
from moderato.llm import transducer

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def packed(strings):
    offsets = np.cumsum([0, *(len(s) for s in strings)])
    return np.frombuffer(b"".join(strings), np.uint8), offsets


@pytest.mark.parametrize("alphabet", [b"ab", b"abcdefgh", bytes(range(256))])
def test_transducer(alphabet):
    rng = random.Random(1)
    words = sorted({bytes(rng.choice(alphabet) for _ in range(rng.randrange(7))) for _ in range(400)})
    t = transducer.Transducer.from_bytes(transducer.build(words).to_bytes())
    assert t.ordinals(*packed(words)).tolist() == list(range(len(words)))
    assert [t.string(i) for i in range(len(words))] == words
    other = [w + b"a" for w in words] + [w[:-1] for w in words]
    place = {w: i for i, w in enumerate(words)}
    assert t.ordinals(*packed(other)).tolist() == [place.get(w, -1) for w in other]
    # minimal: one state for each set of endings
    endings = {}
    for w in words:
        for i in range(len(w) + 1):
            endings.setdefault(w[:i], set()).add(w[i:])
    assert len(t.final) == len({frozenset(e) for e in endings.values()})
    assert transducer.build([]).ordinals(*packed([b"", b"a"])).tolist() == [-1, -1]
    long = [b"x" * 50_000, b"x" * 50_001]
    assert transducer.build(long).ordinals(*packed([*long, b"x" * 49_999])).tolist() == [0, 1, -1]
    with pytest.raises(ValueError):
        transducer.build([b"b", b"a"])


def plain(rows, min_docs=3, top=200):
    terms = [(r[0] or "", r[1] or "", Counter(TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[2] or "")))) for r in rows]
    out = set()
    for lang in {t[0] for t in terms}:
        docs = Counter(w for la, _, c in terms if la == lang for w in c)
        kept = [w for w, n in docs.items() if n >= min_docs]
        count = {}
        for la, so, c in terms:
            if la == lang:
                count.setdefault(so, Counter()).update({w: c[w] for w in kept if w in c})
        count_all = sum(count.values(), Counter())

        def p(c, w):
            return 1 + 1_000_000_000 * (c[w] + 1) // (sum(c.values()) + len(kept))  # noqa: B023
        for so, c in count.items():
            pairs = [(x, sum((p(c, w) - p(d, w)) ** 2 // p(d, w) for w in kept)) for x, d in count.items() if x != so]
            best = [(w, (p(c, w) - p(count_all, w)) ** 2 // p(count_all, w)) for w in kept if c[w] and p(c, w) > p(count_all, w)]
            for part, items, limit in (("pair", pairs, None), ("term", best, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out |= {(lang, so, part, w, v, i + 1) for i, (w, v) in enumerate(ranked)}
    return out


def some_docs(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeÉéß漢\U0001f600") for _ in range(rng.randrange(1, 4))) for _ in range(60)] + ["Alpha", "ALPHA", "x1y"]
    rows = [(rng.choice(["en", "fr", None, ""]), rng.choice(["s0", "s0", "s1", "Ü", None]), " ".join(rng.choice(words) for _ in range(rng.randrange(30))))
            for _ in range(n)]
    rows += rows[:5] + [("en", "s9", None), ("en", "s8", ""), ("de", "only", "eins zwei"), ("de", "other", "1 2"), ("e\0n", "z", "q q"), ("xx", "lone", "a")]
    return rows + [("en", "long", "longword" * 4000 + " alpha " * 3000)] * 3


@pytest.mark.parametrize("limits", [{}, {"shard_bytes": 40, "round_bytes": 2000, "cells": 12}])
def test_audit(spark, limits):
    rows = some_docs(2, 150)
    df = spark.createDataFrame([(*r, i, 1, "k") for i, r in enumerate(rows)], "lang string, source string, text string, ordinal int, n int, block string")
    got = dv.source_divergence(df.repartition(4), top=7, **limits)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows, top=7)


def test_query_and_empty_table(spark, tmp_path):
    rows = some_docs(5, 40)
    schema = "lang string, source string, text string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in dv.op12_source_divergence(spark, str(tmp_path)).collect()} == plain(rows)
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert dv.op12_source_divergence(spark, f"{tmp_path}/none").collect() == []
    spark.createDataFrame([("a", "b", "1"), ("a", "c", None)], schema).write.parquet(f"{tmp_path}/bare/documents.parquet")
    assert {tuple(r) for r in dv.op12_source_divergence(spark, f"{tmp_path}/bare").collect()} == {("a", "b", "pair", "c", 0, 1), ("a", "c", "pair", "b", 0, 1)}


def test_share_is_exact():
    rng = random.Random(3)
    for _ in range(300):
        whole = rng.randrange(1, 9 * 10**15)
        count = rng.randrange(whole)
        assert dv.share(np.array([count]), np.array([whole]))[0] == 1 + 10**9 * (count + 1) // whole
