"""Content-defined chunks against a plain version: the rolling hash byte by byte, digests in a dict."""
import hashlib
import random

from moderato.llm import substring_dedup as sd


def _ends(raw):
    gear, out, h, start = [int(x) for x in sd._gear()], [], 0, 0
    for i, byte in enumerate(raw):
        h = (h << 1) + gear[byte] & 0xFFFFFFFF
        size = i + 1 - start
        if size >= sd.MIN_CHUNK and h >> (32 - sd.CUT_BITS) == 0 or size == sd.MAX_CHUNK or i + 1 == len(raw):
            out.append(i + 1)
            start = i + 1
    return out


def _spans(rows):
    texts = {}
    for i, t in rows:
        if i is not None and t is not None:
            texts[i] = min(t, texts.get(i, t))
    first, found = {}, []
    for i in sorted(texts):
        raw, start, run, mine = texts[i].encode(), 0, None, []
        spans = []
        for end in [*_ends(raw), None]:
            key = hashlib.blake2b(raw[start:end], digest_size=16).digest() if end is not None else None
            if key in first:
                run = (run[0] if run else start, end)
            elif run:
                spans.append(run)
                run = None
            mine.append(key)
            start = end
        found += [(i, a, b) for a, b in spans if b - a >= sd.MIN_SPAN or (a, b) == (0, len(raw))]
        for key in mine:
            if key is not None:
                first.setdefault(key, i)
    return sorted(found)


def _frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_spans_equal_the_plain_version(spark):
    rng = random.Random(3)
    words = [("".join(rng.choices("abcdefghijklmnopqrstuvwxyzé", k=rng.randint(1, 9)))) for _ in range(400)]
    some = lambda n: " ".join(rng.choices(words, k=n))
    passages = [some(rng.randint(30, 80)) for _ in range(6)]
    rows = [(i, some(rng.randint(0, 60)) + rng.choice([*passages, ""]) + some(rng.randint(0, 60))) for i in range(150)]
    rows += [(200 + i, rows[i][1]) for i in range(0, 20)] + [(300 + i, "short one") for i in range(5)] + [(400, "x" * 5000), (401, "x" * 7000)]
    rows += [(500, None), (501, ""), (502, ""), (None, passages[0]), (None, passages[0]), (600, passages[1] + "b"), (600, passages[2]),
             (700, "é" * 90 + passages[3] * 40), (-5, passages[4])]
    rng.shuffle(rows)
    got = sorted((r.id, r.start, r.end) for r in sd.repeated_spans(_frame(spark, rows)).collect())
    assert got == _spans(rows) and len(got) > 60


def test_short_copies_go_whole(spark):
    rows = [(1, "a text of few bytes"), (2, "a text of few bytes"), (3, "a text of few bytes, and more"), (4, "b")]
    assert [tuple(r) for r in sd.repeated_spans(_frame(spark, rows)).collect()] == [(2, 0, 19)]


def test_passages_of_fifty_words_are_caught(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 8))) for _ in range(3000)]
    some = lambda n: " ".join(rng.choices(words, k=n))
    rows = []
    for i in range(300):
        passage = some(51)
        rows += [(2 * i, f"{some(40)} {passage} {some(40)}"), (2 * i + 1, f"{some(30)} {passage} {some(50)}")]
    hit = {r.id for r in sd.repeated_spans(_frame(spark, rows)).collect()}
    assert all(i % 2 for i in hit) and len(hit) >= 294


def test_odd_tables(spark):
    empty = _frame(spark, [])
    assert sd.repeated_spans(empty).count() == 0
    rows = _frame(spark, [(1, "x y"), (1, "x z"), (None, "n"), (None, "n"), (2, None)])
    spans = spark.createDataFrame([], "id long, start long, end long")
    kept = sorted(((r.id or 0), bytes(r.kept)) for r in sd.remove_spans(rows, spans).collect())
    assert kept == [(0, b"n"), (0, b"n"), (1, b"x y"), (2, b"")]
