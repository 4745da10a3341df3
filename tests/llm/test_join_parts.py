"""Parts of operator 10: the stream of postings, the sieve, and groups below the similarity."""

import itertools
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from moderato.llm import common, ngram_join


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_stream_of_postings(size):
    rng = random.Random(size)
    rows = sorted((rng.randrange(40), i, rng.randrange(99), rng.randrange(3)) for i in range(90))
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i:i + size], strict=True)], names=["key", "id", "info", "label"])
               for i in range(0, len(rows), size)]
    out = [tuple(r.values()) for b in ngram_join._with_hubs(False)(iter(batches)) for r in b.to_pylist()]
    want, crossing = [], []
    for _, group in itertools.groupby(rows, key=lambda r: r[0]):
        group = list(group)
        hub = group[0]
        want += [(*r[:3], hub[1], hub[2]) for r in group if len(group) > 1]
        crossing += [(*r[:3], hub[1], hub[2]) for r in group if r[3] != hub[3]]
    assert sorted(out) == sorted(want)
    out = [tuple(r.values()) for b in ngram_join._with_hubs(True)(iter(batches)) for r in b.to_pylist()]
    assert sorted(out) == sorted(crossing)


def test_sieve(spark):
    rows = spark.range(0, 50_000).select(F.col("id"), F.lit("t").alias("_byte_"), (F.col("id") % 7).alias("_x"))
    wanted = spark.range(0, 50_000, 9)
    got = {r.id for r in common.sieve(rows, "id", wanted).collect()}
    assert got >= set(range(0, 50_000, 9)) and len(got) < 50_000 / 4
    assert {r.id for r in common.sieve(rows, "id", wanted, max_bits=1 << 15).collect()} >= set(range(0, 50_000, 9))
    assert common.sieve(rows, "id", wanted.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a"), (1, "b")], "id long, t string")
    assert common.sieve(nulls, "id", spark.createDataFrame([(1,)], "id long")).filter("id = 1").count() == 1


def test_discard(spark):
    df = common.stage(spark.range(5), "gone")
    assert df.count() == 5
    common.discard(df)
    with pytest.raises(Exception, match="does not exist|FILE_NOT_EXIST|no longer exist"):
        spark.read.schema("id long").parquet(df.staged_at).count()


def test_groups_that_share_a_passage_below_the_similarity(spark):
    """Many texts hold one passage for some 70 % of their words; a few of them link, and the pairs that are verified stay few."""
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(70)]
    rows = []
    for i in range(400):
        own = [word() for _ in range(rng.choice([25, 30, 35]))]
        rows.append((2 * i, " ".join(passage + own)))
        if i % 20 == 0:
            rows.append((2 * i + 1, " ".join(passage + own[:-2] + [word()])))
    seen = []
    verify = ngram_join.verify

    def counted(pairs, *args):
        seen.append(pairs.count())
        return verify(pairs, *args)
    ngram_join.verify = counted
    try:
        out = {r.id: r.component for r in ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        ngram_join.verify = verify
    sets = {i: {tuple(w[j:j + 5]) for j in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            lo, hi = sorted((root[a], root[b]))
            root = {k: lo if v == hi else v for k, v in root.items()}
    assert out == root
    assert sum(seen) < 6 * len(rows)


def test_many_pairs_meet_the_texts_in_a_shuffle(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{rng.randrange(9)}" for _ in range(12))) for i in range(60)]
    rows += [(100 + i, t + (" z" if i % 2 else "")) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    few = ngram_join.jaccard_classes(df).orderBy("id").collect()
    monkeypatch.setattr(ngram_join, "BROADCAST_PAIRS", 0)
    assert ngram_join.jaccard_classes(df).orderBy("id").collect() == few
