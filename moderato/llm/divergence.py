"""Source divergence audit (operator 12): how far each source's words lie from the
other sources' and from its language's.

1. *Kept terms.*  Tasks count, for blocks of text, in how many documents of a
   language a term occurs; one shuffle of these counts by (language, term) gives the terms kept.
2. *Vocabulary.*  Kept terms are sorted over the cluster; each task builds minimal
   acyclic transducers of at most ``SHARD_BYTES`` of terms from its sorted part.  A key is the language, a
   zero character and the term, so one transducer holds terms of several languages and a
   term's ordinal, the shard's offset added, follows the order of UTF-8 within a language.
3. *Recount.*  The texts are streamed through the transducers, and (language,
   source, ordinal) is counted: from here on only integers are shuffled.  Transducers are
   broadcast in rounds of at most ``ROUND_BYTES``, measured; one round is the rule, further rounds
   read the texts again.
4. *Divergence.*  Blocks of consecutive ordinals of one language, with the totals of all its sources,
   go to tasks, which compare the sources of a block as a dense integer matrix of at
   most ``CELLS`` counts.  Sums over blocks and the best terms of each source, ordinals telling ties apart, follow
   in Spark.  No term meets another, and pairs are made of sources only, as the result has them.

Arithmetic is in whole numbers throughout.  Null text, language and source are empty strings; all rows count,
whatever their ids, repeated ones too; an empty table gives an empty result; a text is never cut,
and other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from moderato.llm.common import documents, stage
from moderato.llm.textbytes import blocks, lower_ascii, utf8, word_spans
from moderato.llm.transducer import Transducer, build

MIN_DOCS = 3
TOP = 200
SCALE = 1_000_000_000
BLOCK = 8 << 20          # text counted at once inside a task
SHARD_BYTES = 2 << 20    # keys of one transducer
ROUND_BYTES = 32 << 20   # transducers that a task holds at once
CELLS = 1 << 18          # counts compared at once: terms of a block times sources
HELD = 1 << 20           # counts held by a task of the recount

#: For each byte, whether it belongs to a term: letters and all but ASCII.
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _plain(column: pa.Array) -> pa.Array:
    column = pc.fill_null(column.cast(pa.large_string()), "")
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For each occurrence of a term its row and its place among the distinct terms, and those."""
    low = lower_ascii(data)
    letter = _LETTER[low]
    starts, ends = word_spans(letter, offsets)
    lengths = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=lengths[1:])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(lengths), pa.py_buffer(low[letter]))
    coded = words.dictionary_encode()
    return np.searchsorted(offsets, starts, "right") - 1, coded.indices.to_numpy(), coded.dictionary


def _blocks(batch: pa.RecordBatch, text: int):
    data, offsets = utf8(batch.column(text))
    for a, b in blocks(offsets, BLOCK):
        yield a, b, *_terms(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])


def _frequencies(batches):
    """Documents of a block that hold a term, by language."""
    for batch in batches:
        langs = _plain(batch.column(0)).dictionary_encode()
        lang_of = langs.indices.to_numpy()
        for a, _, row, code, terms in _blocks(batch, 1):
            n = len(terms)
            if not n:
                continue
            held = np.unique(row * n + code)
            pair, docs = np.unique(lang_of[a + held // n].astype(np.int64) * n + held % n, return_counts=True)
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(pair // n)).cast(pa.string()), terms.take(pa.array(pair % n)).cast(pa.string()),
                                              pa.array(docs.astype(np.int64))], names=["lang", "term", "docs"])


def _shards(shard_bytes: int):
    """Transducers of the sorted keys that come in."""
    def made(held):
        t = build(held)
        blob = t.to_bytes()
        return pa.RecordBatch.from_arrays([pa.array([held[0]], pa.binary()), pa.array([t.size], pa.int64()), pa.array([len(blob)], pa.int64()),
                                           pa.array([blob], pa.binary())], names=["first", "terms", "bytes", "blob"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for key in batch.column(0).to_pylist():
                key = key.encode()
                if held and size + len(key) > shard_bytes:
                    yield made(held)
                    held, size = [], 0
                held.append(key)
                size += len(key)
        if held:
            yield made(held)
    return run


class _Round:
    """The transducers of one round, as tasks use them."""

    def __init__(self, shards: list[tuple[bytes, int, bytes]]):
        self.first = [f for f, _, _ in shards]
        self.start = [s for _, s, _ in shards]
        self.shards = [Transducer.from_bytes(b) for _, _, b in shards]

    def ordinals(self, keys: pa.Array) -> np.ndarray:
        """Ordinals of distinct keys, -1 for those of no transducer here."""
        if len(self.shards) == 1:
            found = self.shards[0].ordinals(*utf8(keys))
            return np.where(found >= 0, found + self.start[0], -1)
        order = pc.sort_indices(keys.cast(pa.large_binary()))
        ranked = keys.take(order)
        out = np.full(len(keys), -1, np.int64)
        texts = ranked.cast(pa.large_binary())
        cuts = [_place(texts, f) for f in self.first] + [len(keys)]
        for shard, start, a, b in zip(self.shards, self.start, cuts[:-1], cuts[1:], strict=True):
            found = shard.ordinals(*utf8(ranked.slice(a, b - a)))
            out[order.to_numpy()[a:b]] = np.where(found >= 0, found + start, -1)
        return out


def _place(ranked: pa.Array, key: bytes) -> int:
    lo, hi = 0, len(ranked)
    while lo < hi:
        mid = (lo + hi) // 2
        if ranked[mid].as_py() < key:
            lo = mid + 1
        else:
            hi = mid
    return lo


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, back, np.concatenate(counts))
    return key, total


def _recount(shared):
    """Occurrences of the round's terms by language, source and ordinal."""
    def run(batches):
        vocabulary, groups, keys, counts, held = _Round(shared.value), {}, [], [], 0

        def rows(key, count):
            names = list(groups)
            of = (key >> 40).astype(np.int64)
            lang, source = (pa.array([n[i] for n in names], pa.string()) for i in (0, 1))
            return pa.RecordBatch.from_arrays([lang.take(pa.array(of)), source.take(pa.array(of)), pa.array(key & ((1 << 40) - 1)), pa.array(count)],
                                              names=["lang", "source", "ordinal", "n"])
        for batch in batches:
            langs, sources = _plain(batch.column(0)), _plain(batch.column(1))
            coded = langs.dictionary_encode()
            lang_of = coded.indices.to_numpy()
            group_of = np.array([groups.setdefault(g, len(groups)) for g in zip(langs.to_pylist(), sources.to_pylist(), strict=True)], np.int64)
            for a, _, row, code, terms in _blocks(batch, 2):
                n = len(terms)
                if not n:
                    continue
                pair, back = np.unique(lang_of[a + row].astype(np.int64) * n + code, return_inverse=True)
                text = pc.binary_join_element_wise(coded.dictionary.take(pa.array(pair // n)), terms.take(pa.array(pair % n)), pa.scalar("\0", pa.large_string()))
                ordinal = vocabulary.ordinals(text)[back]
                known = ordinal >= 0
                key, count = np.unique(group_of[a + row[known]] << 40 | ordinal[known], return_counts=True)
                keys.append(key)
                counts.append(count.astype(np.int64))
                held += len(key)
                if held > 2 * HELD:
                    key, count = _merged(keys, counts)
                    keys, counts, held = [key], [count], len(key)
                    if held > HELD:
                        yield rows(key, count)
                        keys, counts, held = [], [], 0
            if len(groups) > HELD:
                if keys:
                    yield rows(*_merged(keys, counts))
                groups, keys, counts, held = {}, [], [], 0
        if keys:
            yield rows(*_merged(keys, counts))
    return run


def share(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """``1 + floor(SCALE * (count + 1) / whole)`` for ``count < whole``, exact up to a ``whole`` of 9e15."""
    left, out = count + 1, np.zeros_like(count)
    for _ in range(3):                      # three decimal digits at a time
        left = left * 1000
        out = out * 1000 + left // whole
        left = left % whole
    return out + 1


def _compare(top: int):
    """The pairs' sums and the best terms of one block of a language."""
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lang = table.column("lang")[0].as_py()
        ordinal, source = table.column("ordinal"), table.column("source").to_pylist()
        total = pc.is_null(ordinal).to_numpy(zero_copy_only=False)
        n = table.column("n").to_numpy()
        names = sorted({s for s, t in zip(source, total, strict=True) if t}, key=str.encode)
        place = {s: i for i, s in enumerate(names)}
        row = np.array([place[s] for s in source], np.int64)
        whole = np.zeros(len(names), np.int64)
        whole[row[total]] = n[total]
        size = int(table.column("vocabulary").to_numpy()[total][0])
        ordinals, col = np.unique(ordinal.filter(pa.array(~total)).to_numpy(), return_inverse=True)
        count = np.zeros((len(names), len(ordinals)), np.int64)
        count[row[~total], col] = n[~total]
        p = share(count, (whole + size)[:, None])
        q = share(count.sum(0), whole.sum() + size)
        out = {"source": [], "part": [], "item": [], "ordinal": [], "value": []}
        for i, name in enumerate(names):
            apart = ((p[i] - p) ** 2 // p).sum(1)
            others = [j for j in range(len(names)) if j != i]
            above = np.flatnonzero((count[i] > 0) & (p[i] > q))
            value = (p[i, above] - q[above]) ** 2 // q[above]
            best = np.lexsort((ordinals[above], -value))[:top]
            out["source"] += [name] * (len(others) + len(best))
            out["part"] += ["pair"] * len(others) + ["term"] * len(best)
            out["item"] += [names[j] for j in others] + [None] * len(best)
            out["ordinal"] += [None] * len(others) + ordinals[above[best]].tolist()
            out["value"] += apart[others].tolist() + value[best].tolist()
        types = {"source": pa.string(), "part": pa.string(), "item": pa.string(), "ordinal": pa.int64(), "value": pa.int64()}
        made = {k: pa.array(v, types[k]) for k, v in out.items()}
        return pa.table({"lang": pa.array([lang] * len(out["part"]), pa.string())} | made)
    return run


def _strings(shared):
    """The terms of the round's ordinals."""
    def run(batches):
        vocabulary = _Round(shared.value)
        for batch in batches:
            found = []
            for o in batch.column(0).to_pylist():
                at = int(np.searchsorted(vocabulary.start, o, "right")) - 1
                found.append(vocabulary.shards[at].string(o - vocabulary.start[at]).decode().rpartition("\0")[2])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["ordinal", "term"])
    return run


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
                      min_docs: int = MIN_DOCS, top: int = TOP, shard_bytes: int = SHARD_BYTES, round_bytes: int = ROUND_BYTES,
                      cells: int = CELLS) -> DataFrame:
    """``lang, source, part, item, value, rank``: for each source of a language the
    other sources by divergence (part ``pair``) and its ``top`` terms that stand out most from the language (``term``)."""
    spark = docs.sparkSession
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))

    held = rows.select("lang", "text").mapInArrow(_frequencies, "lang string, term string, docs long")
    kept = stage(held.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
                 .select(F.concat("lang", F.lit("\0"), "term").alias("key")), "kept-terms")
    ordered = kept.repartitionByRange("key").sortWithinPartitions("key")
    shards = stage(ordered.mapInArrow(_shards(shard_bytes), "first binary, terms long, bytes long, blob binary"), "transducers")

    # One row a transducer: the vocabulary's size over SHARD_BYTES.
    rounds, start, size = [], 0, round_bytes
    for s in shards.select("first", "terms", "bytes").orderBy("first").collect():
        if not rounds or size + s.bytes > round_bytes:
            rounds.append([])
            size = 0
        rounds[-1].append((bytes(s.first), start))
        start, size = start + s.terms, size + s.bytes
    counts, shared = [], []
    for part in rounds:
        lo, hi = part[0][0], part[-1][0]
        blobs = {bytes(r.first): bytes(r.blob) for r in
                 shards.filter((F.col("first") >= F.lit(lo)) & (F.col("first") <= F.lit(hi))).select("first", "blob").collect()}
        shared.append(spark.sparkContext.broadcast([(f, at, blobs[f]) for f, at in part]))
        counts.append(rows.mapInArrow(_recount(shared[-1]), "lang string, source string, ordinal long, n long"))
    if not counts:
        counts = [spark.createDataFrame([], "lang string, source string, ordinal long, n long")]
    every = counts[0]
    for c in counts[1:]:
        every = every.unionByName(c)
    every = stage(every.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")), "term-counts")

    groups = rows.select("lang", "source").distinct()
    groups = groups.join(every.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left")
    spans = every.groupBy("lang").agg(F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"))
    groups = groups.join(spans, "lang", "left").select(
        "lang", "source", F.coalesce("n", F.lit(0)).alias("n"), "lo", "hi", F.coalesce(F.col("hi") - F.col("lo") + 1, F.lit(0)).alias("vocabulary"))
    groups = stage(groups, "groups")
    widest = groups.groupBy("lang").count().agg(F.max("count")).head()[0] or 1
    wide = max(1, cells // widest)
    block = lambda c: F.expr(f"{c} div {wide}")
    totals = groups.withColumn("block", F.explode(F.when(F.col("lo").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(block("lo"), block("hi")))))
    ins = every.select("lang", block("ordinal").alias("block"), "source", "ordinal", "n", F.lit(0).cast("long").alias("vocabulary")).unionByName(
        totals.select("lang", "block", "source", F.lit(None).cast("long").alias("ordinal"), "n", "vocabulary"))
    found = stage(ins.groupBy("lang", "block").applyInArrow(_compare(top), "lang string, source string, part string, item string, ordinal long, value long"),
                  "divergence")

    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", "part", "item", "value", F.row_number().over(by).alias("rank"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
    best = found.filter("part = 'term'").withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top)
    best = stage(best, "best-terms")
    terms = spark.createDataFrame([], "ordinal long, term string")
    for i, part in enumerate(rounds):
        here = best.select("ordinal").distinct().filter(F.col("ordinal") >= part[0][1])
        if i + 1 < len(rounds):
            here = here.filter(F.col("ordinal") < rounds[i + 1][0][1])
        named = here.mapInArrow(_strings(shared[i]), "ordinal long, term string")
        terms = named if i == 0 else terms.unionByName(named)
    best = best.join(terms, "ordinal").select("lang", "source", "part", F.col("term").alias("item"), "value", "rank")
    return pairs.unionByName(best)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of ``documents`` against each other and against their language."""
    return source_divergence(documents(spark, sf_dir))


_SHARE = "(1 + ({n}::HUGEINT + 1) * 1000000000 // {whole})"

OP12_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= {MIN_DOCS}),
found AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (
  SELECT lang, source, coalesce(total, 0) AS total, coalesce(v, 0) AS v
  FROM (SELECT DISTINCT lang, source FROM docs)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM found GROUP BY ALL) USING (lang, source)
  LEFT JOIN (SELECT lang, count(*) AS v FROM kept GROUP BY lang) USING (lang)),
cells AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, {_SHARE.format(n="coalesce(n, 0)", whole="(total + v)")} AS p
  FROM groups JOIN kept USING (lang) LEFT JOIN found USING (lang, source, term)),
whole AS (
  SELECT lang, term, {_SHARE.format(n="sum(n)", whole="(any_value(total) + any_value(v))")} AS q
  FROM cells JOIN (SELECT lang, sum(total) AS total, any_value(v) AS v FROM groups GROUP BY lang) USING (lang) GROUP BY lang, term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
             FROM cells x JOIN cells y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.other = b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM cells JOIN whole USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value,
       row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term' AS part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms) WHERE rank <= {TOP}"""
