"""Findings of a review: clashing names, copies in a training sample, texts full of hits, notices beside a copyright line."""

import math
import random
import time
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from moderato.llm import hd_language, license_scan, pii
from moderato.llm.pipeline_stages import identify_language


def test_language_columns_of_any_name(spark):
    rows = [(i, t, lang, 1, 2, 3, 4) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "en")] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _text int, _lang int, _score int, told int")
    learned = hd_language.learn_from(docs)
    out = hd_language.predict_language(docs, learned)
    assert out.columns == [*docs.columns, "lang_pred", "score"]
    r = out.filter("doc_id = 1").first()
    assert (r._text, r._lang, r._score, r.told, r.lang_pred) == (1, 2, 3, 4, "de")
    kept = identify_language(spark, docs, "")
    assert kept.columns == docs.columns and {tuple(x)[3:] for x in kept.collect()} == {(1, 2, 3, 4)} and kept.count() == 40


def test_language_against_plain_loops(spark):
    """The same prototypes and cosines by loops over trigrams."""
    rng = random.Random(4)
    parts = {"xx": ["ba", "bo", "ka"], "yy": ["zu", "né", "ka"], "zz": ["Qi", "qo", "ba"]}
    rows = [(i, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(rng.randrange(1, 30))), lang)
            for i in range(120) for lang in [rng.choice(list(parts))]] + [(500, "12 34", "xx"), (501, None, "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = hd_language.learn_from(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in hd_language.predict_language(docs, learned).collect()}

    def grams(text):
        low = [c.lower() if c.isalpha() else " " for c in text or ""]
        pad = [" ", *low, " "]
        return Counter(tuple(ord(c) for c in pad[i:i + 3]) for i in range(len(low)) if low[i] != " ")

    def bundle(counts):
        out = np.zeros(hd_language.DIM)
        for (a, b, c), n in counts.items():
            out += n * hd_language._bound(np.array([a << 42 | b << 21 | c], np.uint64), hd_language.DIM)[0].astype(float)
        return out
    made = {}
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 5:
            made[lang] = made.get(lang, 0) + bundle(grams(text))
    made = {k: v / np.linalg.norm(v) for k, v in made.items()}
    assert learned.keys() == made.keys() and all(np.abs(learned[k] - made[k]).max() < 1e-12 for k in made)
    for i, text, _ in rows:
        v = bundle(grams(text))
        if not v.any():
            assert got[i] == ("und", 0.0)
            continue
        cos = {k: float(v @ p) / np.linalg.norm(v) for k, p in made.items()}
        best = max(cos.values())
        assert math.isclose(got[i][1], min(1.0, max(0.0, best)), abs_tol=1e-5) and cos[got[i][0]] > best - 1e-5


def test_sample_of_distinct_windows(spark):
    rows = [(i, "call +49 30 1234 5678 now") for i in range(3000)] + [(5000 + i, f"write to me{i}@host{i}.example or call +1 212 555 {1000 + i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = docs.select("text").mapInArrow(pii._samples, "key binary, text string, tags binary, some boolean")
    got = pii._distinct(found, 300)
    assert len(got) == 300 and len({(r["text"], bytes(r["tags"])) for r in got}) == 300
    every = sorted({(bytes(r["key"]), r["text"]) for r in found.collect()})
    assert [(bytes(r["key"]), r["text"]) for r in got] == every[:300]
    assert len(pii._distinct(found, 100_000)) == len(every)


def test_license_text_full_of_hits():
    start = time.time()
    r = license_scan.scan(b"cc by x " * 60_000)
    assert r["n_base"] == 60_000 and r["last_word"] == 179_997 and time.time() - start < 20
    assert license_scan.scan("É cc by, é ALL rights reserved".encode())["last_word"] == 4


def test_copyright_line_beside_a_licence():
    line = "Copyright 2020 Someone. All rights reserved.\n"
    r = license_scan.scan((line + "SPDX-License-Identifier: BSD-3-Clause").encode())
    assert r["terms"] == "permissive" and "reserved" in r["base_labels"] and "bsd-3-clause" in r["labels"]
    assert license_scan.scan(line.encode())["terms"] == "reserved"
    assert license_scan.scan((line + "SPDX-License-Identifier: Some-Own-1.0").encode())["terms"] == "unknown"
    notices = {"Permission is hereby granted, free of charge, to any person obtaining a copy of this": "mit",
               "Redistribution and use in source and binary forms, with or without modification, are": "bsd",
               "you may not use this file except in compliance with the License.": "apache-2.0"}
    for text, label in notices.items():
        r = license_scan.scan((line + text).encode())
        assert label in r["labels"].split(",") and r["terms"] == "permissive"


def test_words_of_long_texts_have_the_same_hashes():
    from moderato.llm import textbytes as tb
    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(97, 100, rng.integers(1, 9)).astype(np.uint8)) for _ in range(300_000)]
    data = np.frombuffer(b" ".join(words) + b" " + b"y" * 700_000 + b" abc", np.uint8)
    starts, ends = tb.word_spans(tb._WORD[data], np.array([0, len(data)]))
    got = tb.range_hashes(data, starts, ends)
    assert len(got) == 300_002
    for i in (0, 1, 150_000, 299_999, 300_000, 300_001):
        w = data[starts[i]:ends[i]].copy()
        assert got[i] == tb.range_hashes(w, np.array([0]), np.array([len(w)]))[0]
