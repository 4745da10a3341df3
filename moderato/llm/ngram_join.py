"""N-gram Jaccard self-join (operator 10) by token-combination prefixes.

A text is the set of its distinct 5-word shingles.  Two texts link when
``100 * |A and B| >= 80 * |A or B|``.

1. One pass over all texts gives each set's size and digest, and counts shingles
   in a sketch of fixed size.  Texts with equal sets form one class; only a
   class's smallest id goes on.
2. The sketch splits shingles into rare and frequent ones and orders them, rare
   first.  Linked sets must share a shingle among the first ``n - ceil(.8 n) + 1``
   of each.  Rare shingles there are indexed one by one.  Where a frequent one
   lies among them, the prefix is extended by ``c`` places: two such sets share a
   rare shingle or at least ``c + 1`` frequent ones, so that by the pigeonhole
   principle two of them fall into the same of ``c`` hash classes.  Pairs of
   frequent shingles within a class are indexed; a frequent one alone never is.
   A text with less than 80 per cent frequent shingles needs no pairs: its links share
   a rare shingle, and an extended prefix holds all of these.
3. One shuffle brings the texts of a key together; a stream in its order keeps
   only keys that several texts have, so most postings end there.  Keys are then resolved by
   components.  In star rounds each text is verified
   against the hub with which it shares most keys.  Then, for each key
   whose texts aren't all in one component, the texts outside its largest
   component meet all the others, once; a pair goes on to verification if its
   shared keys still allow the similarity.  Two extended prefixes hold all rare shingles of their texts, so these
   overlap in no more than their shared rare keys and the smaller number of frequent shingles.  Pairs inside one component need no
   check, so a group of copies costs its size, not its square.
4. Verification recomputes both sets from the whole texts and compares exactly.  The pairs go to
   the texts while they are few, by count; beyond that only texts that a bitmap of the pairs' ids lets through
   are shuffled to them.

Shingles are 64-bit hashes.  Null or word-free texts have an empty set, link with
nothing and are their own component.  Where rows repeat an id, the smallest of
its texts stands for them, in one row; a null id keeps its row, with a null
component.  Columns other than the two named are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moderato.llm.common import components, discard, documents, one_text_per_id, sieve, stage
from moderato.llm.textbytes import blocks, mix, shingle_sets, utf8

PERCENT = 80
K = 5
SKETCH_BITS = (18, 24)  # counters of the shingle sketch, as powers of two: four a text, within these
STAR_ROUNDS = 2
MEMBERS_PER_TASK_KEY = 512
BROADCAST_PAIRS = 1 << 20   # pairs to verify, up to two rows of 40 bytes each, that are sent to the texts; more meet them in a shuffle

_INFO = "kind int, id long, n int, digest binary, part int, counts binary"


def _sets(batch: pa.RecordBatch, column: int, k: int):
    data, offsets = utf8(batch.column(column))
    for a, b in blocks(offsets):
        yield a, b, shingle_sets(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], k)


def _profile(k: int, bits: int):
    """Per text its id, set size and set digest; per task the sketch, in parts."""
    def run(batches):
        counts = np.zeros(1 << bits, np.int64)
        schema = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("n", pa.int32()), ("digest", pa.binary()),
                            ("part", pa.int32()), ("counts", pa.binary())])
        for batch in batches:
            n, digest = [], []
            for _, _, sets in _sets(batch, 1, k):
                for s in sets:
                    n.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                if sets:
                    counts += np.bincount(np.concatenate(sets) >> np.uint64(64 - bits), minlength=1 << bits)
            m = len(n)
            if m:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(m, np.int32)), batch.column(0), pa.array(n, pa.int32()), pa.array(digest, pa.binary()),
                     pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], schema=schema)
        if counts.any():
            parts = [x.tobytes() for x in np.split(counts, 64)]
            m = len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ones(m, np.int32)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()),
                 pa.array(np.arange(m, dtype=np.int32)), pa.array(parts, pa.binary())], schema=schema)
    return run


def _sum_counts(pdf):
    total = sum(np.frombuffer(x, np.int64) for x in pdf["counts"])
    return pdf.head(1)[["part"]].assign(counts=[total.tobytes()])


def _sketch(info: DataFrame, bits: int) -> np.ndarray:
    """All shingle counts by hash bucket: ``2**bits`` numbers, summed in tasks in two steps."""
    rows = info.filter("kind = 1").select("part", "counts")
    rows = rows.groupBy("part", F.pmod(F.spark_partition_id(), F.lit(64)).alias("salt")).applyInPandas(_sum_counts, "part int, counts binary")
    rows = rows.groupBy("part").applyInPandas(_sum_counts, "part int, counts binary").collect()
    parts = {r["part"]: np.frombuffer(r["counts"], np.int64) for r in rows}
    return np.concatenate([parts[i] for i in range(64)]) if parts else np.zeros(1 << bits, np.int64)


def frequent_ranks(counts: np.ndarray) -> np.ndarray:
    """Per bucket 0 if its shingles are rare, else its count above the mean."""
    mean = counts.mean()
    over = counts - mean
    return np.where(over >= 64 + 6 * np.sqrt(mean), over, 0).astype(np.int64)


def _least(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _classes(n: int) -> int:
    """Hash classes for pairs of frequent shingles: a power of two near n / 5."""
    return 1 << max(0, (n // 5).bit_length() - 1)


def prefix_keys(s: np.ndarray, ranks: np.ndarray, bits: int, percent: int):
    """The index keys of one set and the reach of each: a shared key makes two sets
    a pair only if for both ``reach <= n - (overlap that they need)``.  Also the order of
    the prefix's last shingle, whether it was extended, and which keys are one rare shingle."""
    n = len(s)
    base = n - _least(n, percent) + 1
    if n == 0:
        return s[:0], np.zeros(0, np.int64), 0, False, np.zeros(0, bool)
    rank = ranks[s >> np.uint64(64 - bits)]
    order = np.lexsort((s, rank))
    s, rank = s[order], rank[order]
    rare = int(np.searchsorted(rank[:base], 0, "right"))
    keys, reach = [s[:rare]], [np.arange(rare)]
    # With fewer frequent shingles than any link needs in common, a link shares a rare one, and all rare ones are keys.
    if rare < base and n - int(np.searchsorted(rank, 0, "right")) >= _least(n, percent):
        for c in sorted({_classes(n), _classes(_least(n, percent))}):
            f = s[rare:min(n, base + c)]
            cls = (mix(f) & np.uint64(c - 1)).astype(np.int64)
            by = np.argsort(cls, kind="stable")
            f, cls, at = f[by], cls[by], rare + by - c
            # f is in one order for all sets, so a pair is taken the same way round everywhere
            for gap in range(1, len(f)):
                same = cls[gap:] == cls[:-gap]
                if not same.any():
                    break
                keys.append(mix(mix(f[:-gap][same]) + np.uint64(3) * f[gap:][same] + np.uint64(c)))
                reach.append(at[gap:][same])
    keys, reach = np.concatenate(keys), np.concatenate(reach)
    single = np.arange(len(keys)) < rare
    order = np.lexsort((reach, ~single, keys))
    keys, reach, single = keys[order], reach[order], single[order]
    once = np.append(True, keys[1:] != keys[:-1])[:len(keys)]
    last = s[base - 1] >> np.uint64(1)
    return keys[once], reach[once], int(last), rare < base, single[once]


#: A posting's ``info``: set size, reach of the key, whether the prefix was extended and whether the key is one rare shingle.
_POST = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("info", pa.int64()), ("n", pa.int32()), ("last", pa.int64()),
                   ("ext", pa.bool_()), ("frequent", pa.int32())])
_POST_SQL = "key long, id long, info long, n int, last long, ext boolean, frequent int"


def _n(info: str) -> str:
    return f"shiftright({info}, 32)"


def _reach(info: str) -> str:
    return f"(shiftright({info}, 2) & 1073741823)"


def _ext(info: str) -> str:
    return f"(({info} & 2) <> 0)"


def _index(k: int, bits: int, percent: int, shared):
    """Postings of each text, and one row without a key that tells of the text itself."""
    def run(batches):
        ranks = shared.value
        for batch in batches:
            ids = batch.column(0)
            for a, b, sets in _sets(batch, 1, k):
                found = [prefix_keys(s, ranks, bits, percent) for s in sets]
                size = np.array([len(x[0]) for x in found], np.int64)
                own = ids.slice(a, b - a)
                n = np.array([len(s) for s in sets], np.int64)
                frequent = np.array([int((ranks[s >> np.uint64(64 - bits)] > 0).sum()) for s in sets], np.int64)
                ext = np.array([x[3] for x in found], bool)
                m = len(sets)
                yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), own, pa.nulls(m, pa.int64()), pa.array(n.astype(np.int32)),
                                                  pa.array([x[2] for x in found], pa.int64()), pa.array(ext), pa.array(frequent.astype(np.int32))], schema=_POST)
                total = int(size.sum())
                if total:
                    info = (np.repeat(n << 32 | ext.astype(np.int64) << 1, size) | np.concatenate([x[1] for x in found]) << 2
                            | np.concatenate([x[4] for x in found]).astype(np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([x[0] for x in found]).view(np.int64)), own.take(pa.array(np.repeat(np.arange(m), size))),
                         pa.array(info), pa.nulls(total, pa.int32()), pa.nulls(total, pa.int64()), pa.nulls(total, pa.bool_()), pa.nulls(total, pa.int32())],
                        schema=_POST)
    return run


_HUBS = "key long, id long, info long, hub long, hub_info long"


def _with_hubs(labelled: bool):
    """Rows in the order of keys: each row of a key that others have, with the key's first row
    as its hub.  With labels (a further column) only rows of other components than the hub's."""
    def run(batches):
        key = hub = hub_info = label = None
        held = None                      # the first row of a key, until a second one comes
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys, ids, infos = (batch.column(i).to_numpy() for i in range(3))
            first = np.append(keys[:1] != key if key is not None else [True], keys[1:] != keys[:-1])
            start = np.maximum.accumulate(np.where(first, np.arange(n), -1))
            mine = start >= 0            # whose key starts in this batch
            hubs = np.where(mine, ids[start], hub if hub is not None else 0)
            hub_infos = np.where(mine, infos[start], hub_info if hub_info is not None else 0)
            if labelled:
                labels = batch.column(3).to_numpy()
                take = labels != np.where(mine, labels[start], label if label is not None else 0)
                label = int(labels[start[-1]]) if mine[-1] else label
                keep = np.flatnonzero(take)
            else:
                alone = first & np.append(first[1:], False)
                if held is not None and not first[0]:
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (*held, held[1], held[2])], names=["key", "id", "info", "hub", "hub_info"])
                held = None
                if first[-1]:            # may yet be alone
                    alone[-1] = True
                    held = (int(keys[-1]), int(ids[-1]), int(infos[-1]))
                keep = np.flatnonzero(~alone)
            key, hub, hub_info = int(keys[-1]), int(hubs[-1]), int(hub_infos[-1])
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (keys, ids, infos, hubs, hub_infos)], names=["key", "id", "info", "hub", "hub_info"])
    return run


def _compare(k: int, percent: int):
    """Rows sorted by (a, part, b is null first): the hub's text, then its members'."""
    def run(batches):
        at, hub = None, None
        for batch in batches:
            ends, parts, members = (batch.column(i).to_pylist() for i in (0, 1, 2))
            hit_a, hit_b, both = [], [], []
            for lo, hi, sets in _sets(batch, 3, k):
                for i, s in zip(range(lo, hi), sets, strict=True):
                    if members[i] is None:
                        at, hub = (ends[i], parts[i]), s
                    elif at == (ends[i], parts[i]):
                        shared = len(np.intersect1d(hub, s, assume_unique=True))
                        if shared and 100 * shared >= percent * (len(hub) + len(s) - shared):
                            hit_a.append(ends[i])
                            hit_b.append(members[i])
                            both.append(shared)
            yield pa.RecordBatch.from_arrays([pa.array(hit_a, pa.int64()), pa.array(hit_b, pa.int64()), pa.array(both, pa.int32())],
                                             names=["a", "b", "shared"])
    return run


def verify(pairs: DataFrame, texts: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """Those of the pairs ``a, b`` that link, from whole texts (``id, text``).
    A hot ``a`` is dealt out over parts of a bounded number of members."""
    size = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS_PER_TASK_KEY).cast("int").alias("parts"))
    dealt = pairs.join(size, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    hubs = size.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"))
    rows = dealt.select("a", "part", "b", F.col("b").alias("id")).unionByName(hubs.select("a", "part", "b", F.col("a").alias("id")))
    if pairs.count() <= BROADCAST_PAIRS:
        rows = texts.join(F.broadcast(rows), "id")
    else:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        rows = rows.join(sieve(texts, "id", ids), "id")
    rows = rows.select("a", "part", "b", "text")
    return (rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
            .mapInArrow(_compare(k, percent), "a long, b long, shared int"))


def _may_link(x: str, y: str, percent: int = PERCENT):
    """Whether the sizes allow the similarity and, for two extended prefixes, the key
    lies within what the overlap that these sizes need leaves of both.  ``x`` and ``y`` name postings' infos."""
    nx, ny = _n(x), _n(y)
    need = f"ceil({percent} * ({nx} + {ny}) / {100 + percent}D)"
    return F.expr(f"100 * least({nx}, {ny}) >= {percent} * greatest({nx}, {ny}) AND (NOT ({_ext(x)} AND {_ext(y)}) OR "
                  f"{_reach(x)} <= {nx} - {need} AND {_reach(y)} <= {ny} - {need})")


def _best_hubs(rows: DataFrame) -> DataFrame:
    """For each text the hub with which it shares most keys."""
    met = rows.filter("id <> hub").filter(_may_link("info", "hub_info")).groupBy("id", "hub").agg(F.count(F.lit(1)).alias("c"))
    best = met.groupBy("id").agg(F.max_by("hub", F.struct("c", "hub")).alias("hub"))
    return best.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K,
                    percent: int = PERCENT) -> DataFrame:
    """``id, n_shingles, component`` for every row; ``component`` is the smallest
    id reachable by links of at least ``percent`` per cent similarity."""
    spark = docs.sparkSession
    bits = min(max((4 * docs.count()).bit_length() - 1, SKETCH_BITS[0]), SKETCH_BITS[1])
    every = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    every = one_text_per_id(every)
    info = stage(every.mapInArrow(_profile(k, bits), _INFO), "shingle-sets")
    ranks = spark.sparkContext.broadcast(frequent_ranks(_sketch(info, bits)))
    sized = info.filter("kind = 0").select("id", "n", "digest")
    heads = sized.filter("n > 0").groupBy("digest").agg(F.min("id").alias("head"))
    classes = stage(sized.join(heads, "digest", "left")
                    .select("id", "n", F.when(F.col("n") > 0, F.col("head")).otherwise(F.col("id")).alias("head")), "classes")
    discard(info)

    # A copy that the sieve lets through does no harm: it links with its head.
    texts = sieve(every.filter("id IS NOT NULL"), "id", classes.filter("n > 0 AND id = head").select("id"))
    index = stage(texts.mapInArrow(_index(k, bits, percent, ranks), _POST_SQL), "postings")
    posts = index.filter("key IS NOT NULL").select("key", "id", "info")
    posts = stage(posts.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_with_hubs(False), _HUBS), "shared")
    about = stage(index.filter("key IS NULL").select("id", "n", "last", "ext", "frequent"), "texts")
    discard(index)

    links = None
    for turn in range(STAR_ROUNDS):
        if turn:
            order = [F.xxhash64(F.lit(turn), "id"), F.col("id")]
            rows = _labelled(posts, links).repartition("key").sortWithinPartitions("key", *order).mapInArrow(_with_hubs(True), _HUBS)
        else:
            rows = posts
        pairs = stage(_best_hubs(rows), "stars")
        found = verify(pairs, texts, k, percent).select("a", "b")
        links = stage(found if links is None else links.unionByName(found), "links")
    open_keys = _unresolved(_labelled(posts, links).join(about.select("id", "frequent"), "id"))
    pairs = stage(_crossing(open_keys, about, percent), "crossing")
    links = stage(links.unionByName(verify(pairs, texts, k, percent).select("a", "b")), "links")
    discard(posts)
    joined = components(links)
    out = classes.join(joined, F.col("head") == F.col("node"), "left")
    return out.select("id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "head").alias("component"))


def _labelled(posts: DataFrame, links: DataFrame) -> DataFrame:
    """``key, id, info`` with the components of now."""
    label = components(links).select(F.col("node").alias("id"), "component")
    return posts.select("key", "id", "info").join(label, "id", "left").select("key", "id", "info", F.coalesce("component", "id").alias("component"))


def _unresolved(posts: DataFrame) -> DataFrame:
    """Postings of keys whose texts aren't all in one component."""
    posts = stage(posts, "labelled")
    keys = posts.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
    out = stage(posts.join(keys, "key", "left_semi"), "unresolved")
    discard(posts)
    return out


def _crossing(posts: DataFrame, about: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` that share a key, lie in different components and may
    still reach the similarity.

    For a key, every such pair has an end outside the key's largest component.
    Without extended prefixes the shared keys are all shared shingles up to the
    earlier of the prefixes' ends, and those after it are at most what
    is left of that text.  With two extended ones all rare shingles of both are keys, so a pair
    that needs more than its frequent shingles meets at a rare key, and pair keys only serve the others."""
    size = posts.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    major = size.groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("major"))
    tagged = posts.join(major, "key").withColumn("inner", F.col("component") == F.col("major")).drop("major")
    x, y = tagged.filter("NOT inner").alias("x"), tagged.alias("y")
    need = f"ceil({percent} * ({_n('x.info')} + {_n('y.info')}) / {100 + percent}D)"
    apart = F.expr(f"x.key = y.key AND x.component <> y.component AND (y.inner OR x.id < y.id) AND (x.info & 1 = 1 OR least(x.frequent, y.frequent) >= {need})")
    met = x.join(y, apart & _may_link("x.info", "y.info", percent))
    pair = met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), F.expr("x.info & 1").alias("rare"))
    pair = pair.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.sum("rare").alias("rare"))
    for e in "ab":
        pair = pair.join(about.select(F.col("id").alias(e), *[F.col(c).alias(e + c) for c in ("n", "last", "ext", "frequent")]), e)
    need = F.expr(f"ceil({percent} * (an + bn) / {100 + percent}D)")
    left = lambda e: F.expr(f"ceil({percent} * {e}n / 100D) - 1")  # noqa: E731  what follows the prefix
    rest = F.when(F.col("alast") < F.col("blast"), left("a")).when(F.col("alast") > F.col("blast"), left("b")).otherwise(
        F.greatest(left("a"), left("b")))
    rest = F.when(F.expr("NOT aext AND NOT bext"), rest).otherwise(F.greatest(left("a"), left("b")))
    both = F.expr("aext AND bext")
    overlap = F.when(both, F.col("rare") + F.least("afrequent", "bfrequent")).otherwise(F.col("c") + rest)
    return pair.filter(overlap >= need).select("a", "b")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id`` at 5 words and 0.8."""
    return jaccard_classes(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
