"""The dealt operators against brute force, on small tables with every odd case:
nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from moderato.llm import (char_tagger, decontaminate, embedding_dedup, hd_language, license_scan, ngram_join, packing, pii, pii_rules,
                          substring_dedup, suffix_array, suffix_dedup, warc)

WORDS = "alder birch cedar dogwood elm fir gum hazel ivy juniper kapok larch maple neem oak pine quince rowan spruce teak".split()


def _text(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def _edited(rng, text, k):
    w = text.split(" ")
    for _ in range(k):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, a passage in a third of the texts, and odd rows."""
    rng = random.Random(4)
    passage = _text(rng, 60)
    base = [_text(rng, rng.randrange(30, 120)) for _ in range(8)]
    texts = [*base, *base[:4], base[0], base[0]]
    texts += [_edited(rng, t, 1 + i % 4) for i, t in enumerate(base * 3)]
    texts += [f"{_text(rng, 20)} {passage} {_text(rng, 25)}" for _ in range(20)]
    texts += [None, "", "   ", "one two", "One  two", "one two three four five", "a" * 5000, _text(rng, 4000), "ÄÖ ü ß 漢字 \0 x"]
    return list(enumerate(texts))


def _frame(spark, rows):
    """Documents with further columns whose names are used inside the operators."""
    return spark.createDataFrame([(i, t, "n", 1, "k") for i, t in rows], "doc_id long, text string, id string, n int, key string")


def _components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def _shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def test_ngram_join_matches_all_pairs(spark, corpus):
    got = {r.id: (r.n_shingles, r.component) for r in ngram_join.jaccard_classes(_frame(spark, corpus)).collect()}
    sets = {i: _shingles(t) for i, t in corpus}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0]
    part = _components(sets, links)
    assert got == {i: (len(s), part[i]) for i, s in sets.items()}
    assert len(links) > 15


def test_ngram_join_odd_tables(spark):
    assert ngram_join.jaccard_classes(_frame(spark, [])).count() == 0
    rows = ngram_join.jaccard_classes(_frame(spark, [(3, "b c d e f g"), (3, "a c d e f g"), (None, "x"), (1, "a c d e f g")])).collect()
    assert {(r.id, r.component) for r in rows} == {(3, 1), (None, None), (1, 1)}


def test_extended_prefixes_share_a_key():
    """Linked sets of frequent shingles alone meet, at a key within both reaches."""
    rng = np.random.default_rng(3)
    ranks = np.ones(1 << 18, np.int64)
    for _ in range(60):
        n = int(rng.integers(5, 300))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.append(x[rng.permutation(len(x))[:-(-9 * len(x) // 10)]], rng.integers(0, 2**63, len(x) // 20).astype(np.uint64)))
        both = len(np.intersect1d(x, y))
        if 100 * both < 80 * (len(x) + len(y) - both) or np.array_equal(x, y):
            continue
        need = -(-80 * (len(x) + len(y)) // 180)
        (kx, rx, *_), (ky, ry, *_) = (ngram_join.prefix_keys(s, ranks, 18, 80) for s in (x, y))
        _, i, j = np.intersect1d(kx, ky, return_indices=True)
        assert ((rx[i] <= len(x) - need) & (ry[j] <= len(y) - need)).any()


def test_suffix_array_orders_and_prefixes():
    rng = np.random.default_rng(1)
    for turn in range(40):
        parts = [rng.integers(1, 2 + turn % 4, rng.integers(1, 40)) for _ in range(rng.integers(1, 8))]
        text = np.concatenate([np.append(p, 0) for p in parts]).astype(np.uint16)
        order, lcp = suffix_array.suffix_array(text, 50, memory=200 if turn % 2 else 1 << 20)
        t = text.tolist()
        cut = [tuple(itertools.takewhile(bool, t[i:])) for i in order.tolist()]
        assert sorted(order.tolist()) == list(range(len(t))) and cut == sorted(cut)
        for x in range(2, len(t)):
            a, b = cut[x - 1], cut[x]
            same = next((i for i, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))
            if same < min(len(a), len(b)):
                assert lcp[x] == min(same, 50)


def _exact(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        w = [b[j:j + 50] for j in range(len(b) - 49)]
        gone = np.zeros(len(b) + 1, bool)
        for j, x in enumerate(w):
            if x in seen:
                gone[j:j + 50] = True
        runs = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out[i] = (len(b), int(gone[:-1].sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone[:-1]].tobytes()).hexdigest())
        seen.update(w)
    return out


def test_suffix_dedup_matches_brute_force(spark, corpus):
    rows = suffix_dedup.remove_repeats(_frame(spark, corpus), with_kept=True).collect()
    assert {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == _exact(corpus)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in rows)


def test_suffix_dedup_odd_tables(spark):
    assert suffix_dedup.remove_repeats(_frame(spark, [])).count() == 0
    long = "x y z " * 20
    rows = suffix_dedup.remove_repeats(_frame(spark, [(None, long), (5, long), (5, long), (7, long)])).collect()
    assert sorted((str(r.id), r.n_removed) for r in rows) == [("5", 0), ("7", 120), ("None", 0)]


def test_substring_dedup_resists_shifts(spark, corpus):
    rng = random.Random(8)
    passage = _text(rng, 120)
    rows = [(0, passage), (1, "shifted " + passage + " end"), (2, _text(rng, 100)), (3, None), (4, "")]
    spans = substring_dedup.repeated_spans(_frame(spark, rows)).collect()
    gone = {i: sum(s.end - s.start for s in spans if s.id == i) for i, _ in rows}
    assert gone[0] == gone[2] == gone[3] == gone[4] == 0 and gone[1] > 0.7 * len(passage)
    kept = {r.id: bytes(r.kept) for r in substring_dedup.remove_spans(_frame(spark, rows), spark.createDataFrame(spans)).collect()}
    assert len(kept[1]) == len(rows[1][1]) - gone[1] and kept[2] == rows[2][1].encode()
    exact = _exact(corpus)          # what goes is a subset of what a document with a smaller id holds
    for r in substring_dedup.repeated_spans(_frame(spark, corpus)).groupBy("id").agg(F.sum(F.col("end") - F.col("start")).alias("n")).collect():
        assert r.n <= exact[r.id][1]
    assert substring_dedup.repeated_spans(_frame(spark, [])).count() == 0


def test_chunks_tile_the_text():
    data = np.random.default_rng(2).integers(0, 256, 50_000).astype(np.uint8)
    ends = substring_dedup.cuts(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes[:-1].min() >= substring_dedup.MIN_CHUNK and sizes.max() <= substring_dedup.MAX_CHUNK


def test_language(spark):
    learned = hd_language.prototypes(spark.createDataFrame(
        [("the cat sat with the other cat", "en"), ("der hund und die katze schlafen", "de"), (None, "en"), ("x", None)], "text string, lang string"))
    docs = spark.createDataFrame([(1, "the other cat", 9.0, "q"), (2, "die katze und der hund", 9.0, "q"), (3, None, None, None), (4, "12 !", 1.0, "q"),
                                  (None, "the cat " * 30_000, 1.0, "q"), (2, "die\0katze", 1.0, "q")], "doc_id long, text string, score double, lang string")
    rows = hd_language.predict_language(docs, learned).collect()
    assert [r.lang_pred for r in rows] == ["en", "de", "und", "und", "en", "de"]
    assert all(0 <= r.score <= 1 for r in rows) and rows[2].score == 0 and rows[0].lang == "q"
    assert hd_language.predict_language(docs.limit(0), learned).count() == 0
    assert {r.lang_pred for r in hd_language.predict_language(docs, {}).collect()} == {"und"}


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = hd_language.op2_hd_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert len(rows) == docs.count() and len(out) > 100 and sum(out) / len(out) >= 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_decontamination(spark):
    rng = random.Random(6)
    items = [(i, _text(rng, 25)) for i in range(6)] + [(6, "too short"), (7, None), (8, ""), (2, "zzz repeated item")]
    text = dict(items[:6])
    docs = [(1, f"{_text(rng, 40)} {text[0]} {_text(rng, 10)}"), (2, text[1].upper().replace(" ", ", ")), (3, _text(rng, 80)), (4, None), (5, ""),
            (6, f"{text[3]} {_text(rng, 300)} {text[4]}"), (7, "it is too short"), (8, " ".join(text[5].split()[:12])), (None, text[0]), (1, "again")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, id int")
    rows = decontaminate.contamination_report(_frame(spark, docs), bench).collect()
    assert sorted((r.id or 0, r.item_ids) for r in rows) == [(0, ""), (1, "0"), (1, "0"), (2, "1"), (3, ""), (4, ""), (5, ""), (6, "3,4"),
                                                             (7, "6"), (8, "")]
    assert not any(r.contaminated for r in decontaminate.contamination_report(_frame(spark, docs), bench.limit(0)).collect())
    assert decontaminate.contamination_report(_frame(spark, []), bench).count() == 0


def _plain_similarity(text, item, weight, k=5):
    """The best window of an item's size that a shared shingle aligns, by plain loops."""
    w, v = text.split(), item.split()
    grams = [tuple(v[i:i + k]) for i in range(len(v) - k + 1)]
    starts = {max(p - q, 0) for p in range(len(w) - k + 1) for q, g in enumerate(grams) if tuple(w[p:p + k]) == g}
    held = lambda a: {tuple(w[i:i + k]) for i in range(a, min(a + len(v), len(w)) - k + 1)} & set(grams)
    return max((sum(weight[g] for g in held(a)) / sum(weight[g] for g in set(grams)) for a in starts), default=0.0)


def _matches_plain(spark, items, texts):
    shared = {}
    for i, t in items:
        w = t.split()
        for g in {tuple(w[j:j + 5]) for j in range(len(w) - 4)}:
            shared.setdefault(g, set()).add(i)
    weight = {g: 1 / len(s) for g, s in shared.items()}
    want = {(d, i): s for d, t in texts for i, x in items if (s := _plain_similarity(t, x, weight)) >= 0.8 - 1e-9}
    got = decontaminate.contaminated(_frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.id, r.item): r.similarity for r in got}
    assert all(abs(want[x] - s) < 1e-6 for x, s in got.items())        # nothing else, and the exact similarity
    return want, got


def _recall(want, got):
    """By similarity: 0.8 to 0.85, to 0.9, to 0.95, to 1."""
    out = {}
    for lo in (0.8, 0.85, 0.9, 0.95):
        mine = [x for x, s in want.items() if lo - 1e-9 <= s < lo + 0.05 - 1e-9 or lo == 0.95 and s > 0.95 - 1e-9]
        out[lo] = (len(mine), sum(x in got for x in mine) / max(1, len(mine)))
    return out


def test_decontamination_finds_partial_quotes(spark):
    rng = random.Random(16)
    items, texts = [(i, _text(rng, rng.randrange(15, 60))) for i in range(30)], []
    for i, t in items:
        w = t.split()
        for share in (0.7, 0.8, 0.85, 0.9, 0.95):
            n = round(share * len(w))
            texts.append(f"{_text(rng, 9)} {' '.join(w[:n])} {_text(rng, len(w))}")                 # last words cut off
            texts.append(f"{_text(rng, 9)} {' '.join(w[len(w) - n:])}")                             # first words cut off
            a = rng.randrange(1, n)
            texts.append(f"{' '.join(w[:a])} {_text(rng, len(w) - n)} {' '.join(w[a + len(w) - n:])} {_text(rng, 30)}")     # spliced
        texts.append(f"{_text(rng, 5)} {_edited(rng, t, 1)} {_text(rng, 20)}")
    want, got = _matches_plain(spark, items, list(enumerate(texts)))
    assert sum(s < 0.95 for s in want.values()) > 50
    assert all(r >= 0.9 for _, r in _recall(want, got).values()), _recall(want, got)
    bench = spark.createDataFrame(items, "item_id long, text string")
    # The fingerprints decide: a radius of 0 finds only whole quotes, meaningless fingerprints next to nothing.
    none = decontaminate.contaminated(_frame(spark, list(enumerate(texts))), bench, radius=0).count()
    assert none < len(got) / 4
    real = decontaminate.simhash
    decontaminate.simhash = lambda f, keys: real(f, keys).withColumn("fingerprint", F.xxhash64(*keys))
    try:
        assert decontaminate.contaminated(_frame(spark, list(enumerate(texts))), bench).count() < len(got) / 4
    finally:
        decontaminate.simhash = real


def test_decontamination_counts_each_window_once(spark):
    rng = random.Random(17)
    head, long_end, short_end = _text(rng, 24), _text(rng, 16), _text(rng, 8)
    items = [(0, f"{head} {long_end}"), (1, f"{head} {short_end}")]
    texts = [(0, f"{head} {_text(rng, 40)}"), (1, f"{head} {long_end}"), (2, f"{_text(rng, 3)} {head} {short_end} {_text(rng, 9)}")]
    want, got = _matches_plain(spark, items, texts)
    assert set(want) == set(got)


def test_decontamination_weighs_a_common_template(spark):
    rng = random.Random(18)
    template = _text(rng, 30)
    own = [_text(rng, 30) for _ in range(100)]
    items = [(i, f"{template} {t}") for i, t in enumerate(own)]
    texts = [(i, f"{_text(rng, 40)} {t} {_text(rng, 25)}") for i, t in enumerate(own[:20])] + [(100, f"{_text(rng, 8)} {template} {_text(rng, 40)}")]
    want, got = _matches_plain(spark, items, texts)
    assert set(want) == {(i, i) for i in range(20)} and len(got) >= 19


def test_radius_and_repeated_words(spark):
    assert decontaminate.radius_of(0.8) == 18 and decontaminate.radius_of(1.0) == 0
    items = [(0, "a " * 30), (1, "b c " * 12)]
    texts = [(0, "a " * 3000), (1, "x " * 400 + "b c " * 500), (2, "a a a a b c b c")]
    want, got = _matches_plain(spark, items, texts)
    assert set(got) == set(want) == {(0, 0), (1, 1)}


def test_hamming_blocks_find_all_within_radius(spark):
    rng = random.Random(2)
    pairs = []
    for i in range(200):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randrange(19)):
            y ^= 1 << b
        pairs.append((i, x - (1 << 63), y - (1 << 63)))
    df = spark.createDataFrame(pairs, "i int, x long, y long")
    both = df.select(F.arrays_overlap(decontaminate.blocks(F.col("x"), 18), decontaminate.blocks(F.col("y"), 18)).alias("met"))
    assert both.filter("NOT met").count() == 0


def test_embeddings_match_all_pairs(spark):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((6, 24))
    v = np.concatenate([centre[rng.integers(0, 6, 150)] + rng.standard_normal((150, 24)) * s for s in (0.05, 0.25)]).astype(np.float32)
    v = np.concatenate([v, np.repeat(v[:1], 40, axis=0), v[:5] * 1e-20, v[:5] * 1e15])
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)]
    odd = [None, [], [0.0] * 24, [None] + [1.0] * 23, [float("nan")] * 24, [float("inf")] * 24, [1.0, 2.0]]
    rows += [(1000 + i, x, 1) for i, x in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int")
    got = {r.id: (r.links, r.component) for r in embedding_dedup.near_duplicates(df, tile=64).collect()}
    u = v.astype(np.float64)
    u /= np.sqrt((u * u).sum(axis=1))[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    part = _components(range(len(v)), [(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True) if a < b])
    want = {i: (int(near[i].sum()), part[i]) for i in range(len(v))} | {1000 + i: (0, 1000 + i) for i in range(len(odd))}
    assert got == want
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_quantisation_bound_holds():
    rng = np.random.default_rng(9)
    u = embedding_dedup._unit(rng.standard_normal((200, 64)))
    q, s, e = embedding_dedup.quantise(u)
    off = np.abs(u @ u.T - (q.astype(float) @ q.T.astype(float)) * s[:, None] * s)
    assert (off <= e[:, None] * (1 + e) + e).all()


_BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _plain_spans(text):
    out = []
    for kind, p in _BASE.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                    "card": 12 <= len(d) <= 19 and pii_rules.luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], list(_BASE).index(s[0])))


def test_base_spans_match_the_patterns():
    rng = random.Random(12)
    signs = "aZ9.@+-_% ()é\n0145"
    for _ in range(4000):
        t = "".join(rng.choice(signs) for _ in range(rng.randrange(60)))
        assert pii_rules.base_spans(t) == _plain_spans(t)
    for t in ("a@b.c_x@y.z", "1.2.3.4.5.6.7.8", "256.1.1.1 0001.2.3.4", "4111 1111 1111 1111", "+1 (243) 555-5526", "9" * 5000, "a@" * 50):
        assert pii_rules.base_spans(t) == _plain_spans(t)


def test_personal_data(spark):
    rng = random.Random(3)
    rows = [(i, f"{_text(rng, 20)} mail{i}@host{i}.example.com or +1 (2{i % 10}3) 555-01{i % 90 + 10} {_text(rng, 10)}") for i in range(80)]
    rows += [(100, None), (101, ""), (102, "no data here"), (None, "call +44 20 7946 0958"), (0, rows[0][1]),
             (103, "x " * 20_000 + "end@host.org")]
    docs = _frame(spark, rows)
    tagger = pii.learn(docs, epochs=2)
    got = pii.find_personal_data(docs, tagger).collect()
    assert len(got) == len(rows)
    for r, (_, t) in zip(sorted(got, key=lambda r: str(r.id)), sorted(rows, key=lambda r: str(r[0])), strict=True):
        base = [tuple(s) for s in r.base]
        assert base == _plain_spans(t or "") and set(base) <= {tuple(s) for s in r.spans}
    clean = {r.doc_id: r for r in pii.redact(docs, tagger).collect()}
    assert "@" not in clean[1].text and "[EMAIL]" in clean[1].text and clean[100].text is None and clean[102].text == "no data here"
    assert clean[1].id == "n" and clean[103].text.endswith(" [EMAIL]")
    assert pii.learn(_frame(spark, [(1, "nothing")])) is None
    assert pii.find_personal_data(_frame(spark, []), None).count() == 0


def test_tagger_gradients():
    t = char_tagger.Tagger(3, embed=3, hidden=2)
    t.w = {k: v.astype(np.float64) for k, v in t.w.items()}
    rng = np.random.default_rng(0)
    codes, tags = rng.integers(0, 8, (4, 7)), rng.integers(0, 3, (4, 7))
    _, grads = t.loss(codes, tags)
    for k in ("e", "lx", "rh", "o", "a", "s"):
        at = tuple(0 for _ in t.w[k].shape) if k != "e" else (int(codes[0, 0]), 0)
        sums = []
        for d in (1e-2, -2e-2):
            t.w[k][at] += d
            sums.append(t.loss(codes, tags)[0])
        t.w[k][at] += 1e-2
        assert abs((sums[0] - sums[1]) / 2e-2 - grads[k][at]) < 2e-2


def test_overlapping_windows_cover_every_digit():
    text = "a" * 200 + "1" + "b" * 500 + "22" + "c" * 63
    for i, c in enumerate(text):
        if c.isdigit():
            assert any(at <= i < at + pii.WINDOW for at in pii.windows_of(text))


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "é" * 700
    rows = [(1, "http://a/ b\n", big), (2, None, big), (3, "http://c", "<p>small"), (4, "http://d", "<p>small"), (5, "http://e", None),
            (6, "http://f", ""), (7, "http://g", big), (None, "http://h", "<p>none"), (8, "http://i", "z" * 300_000), (3, "http://c", "<p>small")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, kind int")
    made = []
    for name in ("x", "y"):
        uri = f"file://{tmp_path}/{name}"
        manifest = warc.write_warc(pages.repartition(3 if name == "x" else 1), uri, shard_bytes=2000, roll_bytes=300)
        made.append({r.file: r.sha256 for r in manifest.collect()})
        got = warc.read_warc(manifest, uri).collect()
    assert made[0] == made[1] and len(made[0]) > 2
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in got) == [
        (0, "response", 0), (1, "revisit", 7), (2, "revisit", 7), (3, "response", 0), (3, "response", 0), (4, "response", 0),
        (5, "response", 0), (6, "response", 0), (7, "response", 0), (8, "response", 0)]
    html = dict(r[::2] for r in rows)
    for r in got:
        raw = (html[r.page_id] or "").encode()
        assert r.payload_bytes == len(raw) and r.payload_digest == hashlib.sha1(raw).hexdigest()
        assert r.record_type == "revisit" or bytes(r.payload) == raw
    empty = f"file://{tmp_path}/empty"
    assert warc.read_warc(warc.write_warc(pages.limit(0), empty), empty).count() == 0


def test_licences(spark):
    e = lambda t: license_scan.evaluate(license_scan.operands(t))
    assert e(b"MIT OR GPL-3.0-only") == ({"mit", "gpl-3.0"}, 1)
    assert e(b"(MIT OR Apache-2.0) AND GPL-2.0 WITH Classpath-exception-2.0") == ({"mit", "apache-2.0", "gpl-2.0", "classpath-exception-2.0"}, 2)
    assert e(b"MIT AND (GPL-3.0 OR") == ({"mit", "gpl-3.0"}, 3) and e(b"nothing known") is None and e(b")(") is None
    rows = [(1, "All rights reserved. CC BY CC BY"), (2, None), (3, ""), (4, "SPDX-License-Identifier: MIT\nmore"), (5, "gehen mit dem Hund"),
            (None, "general public license"), (1, "All rights reserved. CC BY CC BY"), (6, "é1 " * 50_000 + "cc-by"), (7, "\0cc\0by")]
    got = license_scan.scan_licences(_frame(spark, rows)).collect()
    assert len(got) == len(rows) and got[0] == got[6]
    for r, (_, t) in zip(got, rows, strict=True):
        w = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(i, x) for p, x in license_scan.BASE.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(at), ",".join(sorted({x for _, x in at})))
        assert (r.first_word, r.last_word) == (min((i for i, _ in at), default=None), max((i for i, _ in at), default=None))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    assert got[3].labels == "mit" and got[3].score == 1 and got[4].labels == ""
    assert license_scan.scan_licences(_frame(spark, [])).count() == 0


def test_licence_expressions_are_read_whole():
    def got(text):
        r = license_scan.scan(text.encode())
        return r["labels"], r["terms"]
    tag = "SPDX-License-Identifier: "
    assert got(tag + "MIT AND Artistic-2.0") == ("artistic-2.0,mit", "unknown")
    assert got(tag + "SSPL-1.0 OR MIT") == ("mit,sspl-1.0", "permissive")
    assert got(tag + "LicenseRef-X AND GPL-3.0") == ("gpl-3.0,licenseref-x", "unknown")
    assert got(tag + "GPL-2.0-or-later AND MIT") == ("gpl-2.0,mit", "copyleft")
    assert got(tag + "BSL-1.0") == ("bsl-1.0", "permissive") and got(tag + "Artistic-2.0 WITH LLVM-exception")[1] == "unknown"
    assert got(tag + "GPL-2.0 WITH Foo-exception") == ("foo-exception,gpl-2.0", "copyleft")
    assert got(f"/* {tag}(MIT OR\n *   Artistic-2.0) AND\n *   GPL-3.0-only */") == ("artistic-2.0,gpl-3.0,mit", "copyleft")
    assert got(f"# {tag}MIT\n# AND Zlib") == ("mit", "permissive") and got(tag + "MIT and more. GPL") == ("mit", "permissive")
    assert got(tag + "MIT. And so on") == ("mit", "permissive") and got(tag + "\nMIT")[0] == "" and got(tag + "MIT and GPL-3.0") == ("gpl-3.0,mit", "copyleft")
    assert got("Licensed under the MIT License or\n# the Apache License, Version 2.0") == ("apache-2.0,mit", "permissive")
    assert got("licensed under MIT and Artistic-2.0") == ("artistic-2.0,mit", "unknown")
    assert got("licensed under GPL 2.0 or later\nMIT is a school")[0] == "gpl-2.0"


def _check_packing(rows, seq_len):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in by.values():
        v.sort()
        assert all(o == sum(n for _, n in v[:i]) for i, (o, _) in enumerate(v)) and sum(n for _, n in v) <= seq_len
    return len(by)


def test_packing_sizes(spark):
    rng = random.Random(1)
    for sizes in ([rng.randrange(1, 64) for _ in range(400)], [3] * 300, [33] * 50 + [31] * 50, [64, 65, 1], []):
        df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "uid long, length long").filter("length <= 64")
        rows = packing.pack(df, 64).collect()
        assert len(rows) == sum(n <= 64 for n in sizes)
        used = _check_packing(rows, 64)
        assert used <= 1.12 * sum(n for n in sizes if n <= 64) / 64 + 2 or min(sizes) > 32 or sizes[:2] == [33, 33]


def test_packing_documents(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    rng = random.Random(7)
    texts = [None, "", "  two  blanks\n here ", "a <|endoftext|> b", "it's 42% \t é漢", _text(rng, 900), *(_text(rng, rng.randrange(1, 80)) for _ in range(40))]
    rows = [*enumerate(texts), (None, "no id"), (6, texts[6])]
    got = packing.pack_documents(_frame(spark, rows), seq_len=128, with_ids=True).collect()
    exact = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = []
    for i, t in rows:
        ids = [*exact.encode(t or "", add_special_tokens=False).ids, packing.END_ID]
        first = len(ids) % 128 or 128 if len(ids) > 128 else len(ids)
        for piece, start in enumerate([0, *range(first, len(ids), 128)]):
            part = ids[start:first if not piece else start + 128]
            want.append((i, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), part))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.ids) for r in got), key=str) == sorted(want, key=str)
    used = _check_packing(got, 128)
    assert used <= 1.1 * sum(r.length for r in got) / 128 + 1
    assert packing.pack_documents(_frame(spark, [])).count() == 0
    seqs = packing.sequences(packing.pack_documents(_frame(spark, rows[:10]), seq_len=128, with_ids=True)).collect()
    assert sum(len(s.ids) for s in seqs) == sum(
        len(exact.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows[:10])
