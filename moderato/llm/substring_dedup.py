"""Substring deduplication by content-defined chunks (operator 6).

A gear hash rolls over a text's bytes: it is shifted by one bit a byte and a
fixed random number of the byte is added, so its 32 bits depend on the last 32 bytes
alone.  A chunk ends where the top bits are 0, after ``MIN_CHUNK`` bytes at
least and ``MAX_CHUNK`` at most; an insertion thus moves the cuts around it and no
others.  Chunks are compared by 128-bit digest across documents:  a
chunk is a repeat if a document with a smaller id holds it too.  Adjacent repeats
form a span.  Spans of at least ``MIN_SPAN`` bytes are removed (several chunks, so that a
common phrase alone takes nothing away), and so are spans that are a document's
whole text, however short.

Texts are chunked twice and never moved.  First, digests are grouped with partial sums to
those that several documents hold; then only the chunks that pass a bitmap of these
digests are joined with them.  The join can split a hot digest, so a
passage in a third of all documents is no special case.  The repeats of a document
are joined to spans by a window over that document.

Null texts are empty.  Rows that repeat an id are one document with one row, and the smallest of its
texts stands for them; rows without an id all stay and have nothing removed.
"""

from __future__ import annotations

import functools
import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moderato.llm.common import documents, one_text_per_id, sieve, stage
from moderato.llm.textbytes import mix, utf8

CUT_BITS = 3
MIN_CHUNK = 12
MAX_CHUNK = 96
MIN_SPAN = 96
PIECE = 1 << 20         # bytes of a text hashed at once
ROWS = 64               # texts taken at once


@functools.cache
def _gear() -> np.ndarray:
    return (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, by doubling the width it covers."""
    h, width = _gear()[data], 1
    while width < 32:
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint32(width) if len(h) > width else 0
        h, width = wider, 2 * width
    return h


def cuts(data: np.ndarray, bits: int = CUT_BITS, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> list[int]:
    """Ends of the chunks of one text."""
    marks: list[int] = []
    for a in range(0, len(data), PIECE):
        lead = min(a, 31)
        h = gear_hashes(data[a - lead:a + PIECE])[lead:]
        marks += (np.flatnonzero(h >> np.uint32(32 - bits) == 0) + (a + 1)).tolist()
    out, start, n = [], 0, len(data)
    while start < n:
        i = bisect_left(marks, start + least)
        end = min(marks[i] if i < len(marks) else n, start + most, n)
        out.append(end)
        start = end
    return out


def _chunk(batches):
    for whole in batches:
        for batch in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
            data, offsets = utf8(batch.column(1))
            ids, digests, starts, sizes, last, at = batch.column(0), [], [], [], [], []
            for i, (a, b) in enumerate(zip(offsets.tolist(), offsets.tolist()[1:], strict=False)):
                text, start = data[a:b], 0
                raw = text.tobytes()
                ends = cuts(text)
                for end in ends:
                    digests.append(hashlib.blake2b(raw[start:end], digest_size=16).digest())
                    starts.append(start)
                    sizes.append(end - start)
                    start = end
                at += [i] * len(ends)
                last += [False] * (len(ends) - 1) + [True] * bool(ends)
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at, pa.int64())), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(starts, pa.int64()),
                 pa.array(sizes, pa.int32()), pa.array(last, pa.bool_())], names=["id", "hi", "lo", "start", "size", "last"])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return one_text_per_id(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")))


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, hi, lo, start, size, last`` of every chunk: the halves of its digest, its bytes counted from 0,
    and whether the text ends with it."""
    return _texts(docs, id_col, text_col).filter("id IS NOT NULL").mapInArrow(
        _chunk, "id long, hi long, lo long, start long, size int, last boolean")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_span: int = MIN_SPAN) -> DataFrame:
    """``id, start, end`` of every span of repeated chunks."""
    made = chunks(docs, id_col, text_col)
    first = stage(made.groupBy("hi", "lo").agg(F.min("id").alias("first"), F.max("id").alias("latest"))
                  .filter("first < latest").select("hi", "lo", "first"), "repeats")
    repeats = sieve(made, "hi", first).join(first, ["hi", "lo"]).filter("id > first").select(
        "id", "start", (F.col("start") + F.col("size")).alias("end"), "last")
    order = Window.partitionBy("id").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = repeats.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1))
    runs = marked.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("last").alias("last"))
    whole = (F.col("start") == 0) & F.col("last")
    return spans.filter((F.col("end") - F.col("start") >= min_span) | whole).select("id", "start", "end")


def _cut_out(batches):
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        out = []
        for a, b, spans in zip(offsets.tolist(), offsets.tolist()[1:], batch.column(2).to_pylist(), strict=False):
            raw, kept, at = data[a:b].tobytes(), [], 0
            for s in spans or ():
                kept.append(raw[at:s["start"]])
                at = s["end"]
            out.append(b"".join([*kept, raw[at:]]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "kept"])


def remove_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, kept``: the bytes of each text that lie in no span."""
    lists = spans.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    return _texts(docs, id_col, text_col).join(lists, "id", "left").select("id", "text", "spans").mapInArrow(_cut_out, "id long, kept binary")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, spans``
    (``start:end`` in bytes, comma-joined)."""
    docs = documents(spark, sf_dir)
    by_doc = repeated_spans(docs).groupBy("id").agg(
        F.sum(F.col("end") - F.col("start")).alias("n_removed"), F.count(F.lit(1)).alias("n_spans"),
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("s"))
    sizes = _texts(docs, "doc_id", "text").select("id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    line = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return sizes.join(by_doc, "id", "left").select(
        F.col("id").alias("doc_id"), "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce(line, F.lit("")).alias("spans"))
