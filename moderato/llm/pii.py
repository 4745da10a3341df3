"""Personal data by base patterns and a trained character tagger (operator 5).

Base spans are the matches of four patterns (``pii_rules``).  A
bidirectional LSTM with CRF transitions learns characters' tags (outside,
begin and inside of each kind) from the base spans of a bounded sample:
``SAMPLE`` distinct windows of the whole table, taken by hash, of which half may be
without a span.  A third of the phone numbers learned have their plus sign taken out, so that the tagger
also learns numbers that the patterns miss.

Every text is then tagged in overlapping windows.  A window without a digit
or @ is skipped: every span of every kind holds one.  Windows of several texts are
decoded together; a character's tag comes from the window in whose
middle it lies best, and runs of tags are joined over the whole text.  A joined span is
added if it has its kind's form and overlaps no base span; overlapping
additions give way to the longer.  Base spans always stay.

Null texts are empty.  Every row gives one row, whatever its id; without a row
to learn from only base spans are found.  The window is the unit of memory, so long
texts are handled whole.
"""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moderato.llm.char_tagger import Tagger, encode
from moderato.llm.common import documents, stage
from moderato.llm.pii_rules import ANCHOR, KINDS, base_spans, plausible
from moderato.llm.textbytes import few_rows

WINDOW = 128
STRIDE = 64
SAMPLE = 1536         # windows that the tagger is fitted on, whatever the size of the table
EPOCHS = 6
DECODED = 192         # windows decoded at once


def tags_of(spans: list[tuple[str, int, int]], start: int, size: int) -> np.ndarray:
    """Tags of the characters from ``start`` on: 0, or 1 + 2 kind where a span begins, 2 + 2 kind inside."""
    out = np.zeros(size, np.int8)
    for kind, a, b in reversed(spans):
        k, a, b = KINDS.index(kind), a - start, b - start
        if a < size and b > 0:
            out[max(a, 0):min(b, size)] = 2 + 2 * k
            if a >= 0:
                out[a] = 1 + 2 * k
    return out


def windows_of(text: str) -> list[int]:
    """Starts of the overlapping windows that hold a digit or @."""
    out, last = [], -1
    for m in ANCHOR.finditer(text):
        at = m.start() // STRIDE
        for i in (at - 1, at):
            if i > last and i >= 0 and (i == 0 or i * STRIDE < len(text)):
                out.append(i * STRIDE)
                last = i
    return out


def _samples(batches):
    """Windows to learn from: text, tags and whether there is a span in it."""
    for batch in few_rows(batches):
        keys, texts, tags, some = [], [], [], []
        for text in batch.column(0).to_pylist():
            spans = base_spans(text)
            for at in windows_of(text):
                part = text[at:at + WINDOW]
                inside = [s for s in spans if s[1] < at + WINDOW and s[2] > at]
                keys.append(hashlib.blake2b(part.encode("utf-8", "surrogatepass"), digest_size=8).digest())
                texts.append(part)
                tags.append(tags_of(inside, at, WINDOW).tobytes())
                some.append(bool(inside))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(texts, pa.string()), pa.array(tags, pa.binary()),
                                          pa.array(some, pa.bool_())], names=["key", "text", "tags", "some"])


def _without_plus(text: str, tags: np.ndarray) -> tuple[str, np.ndarray]:
    """The window with the plus signs of its phone numbers taken out."""
    begin, inside = 1 + 2 * KINDS.index("phone"), 2 + 2 * KINDS.index("phone")
    keep = [not (c == "+" and tags[i] == begin) for i, c in enumerate(text)]
    tags = tags.copy()
    for i, k in enumerate(keep):
        if not k and i + 1 < len(tags) and tags[i + 1] == inside:
            tags[i + 1] = begin
    kept = tags[:len(text)][np.array(keep, bool)]
    return "".join(c for c, k in zip(text, keep, strict=True) if k), np.concatenate([kept, np.zeros(WINDOW - len(kept), np.int8)])


def _distinct(windows: DataFrame, n: int) -> list:
    """The ``n`` distinct windows with the smallest keys.  Only windows below a key that about four times as
    many lie below are made distinct; the bound is widened if copies leave too few."""
    place = F.conv(F.hex(F.substring("key", 1, 7)), 16, 10).cast("long")
    part = 4 * n / max(1, windows.agg(F.approx_count_distinct("key")).first()[0])
    while True:
        below = windows.filter(place < int(min(1.0, part) * (1 << 56)) + 1)
        got = below.select("key", "text", "tags", "some").distinct().orderBy("key", "text", "tags").limit(n).collect()
        if len(got) == n or part >= 1:
            return got
        part *= 4


def learn(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, epochs: int = EPOCHS) -> Tagger | None:
    """A tagger fitted to the base spans of a sample of at most ``sample`` windows."""
    texts = docs.select(F.col(text_col).cast("string").alias("text")).filter(F.col("text").rlike(ANCHOR.pattern))
    found = stage(texts.mapInArrow(_samples, "key binary, text string, tags binary, some boolean"), "tagged-windows")
    rows = []
    for some in (True, False):
        rows += _distinct(found.filter(F.col("some") == some), sample // 2)
    if not any(r["some"] for r in rows):
        return None
    pick, codes, tags = random.Random(5), [], []
    for r in rows:
        text, t = r["text"], np.frombuffer(r["tags"], np.int8)
        if pick.random() < 1 / 3:
            text, t = _without_plus(text, t)
        codes.append(encode(text, WINDOW))
        tags.append(t)
    tagger = Tagger(1 + 2 * len(KINDS))
    tagger.fit(np.stack(codes), np.stack(tags).astype(np.int64), epochs)
    return tagger


def joined(tags: np.ndarray) -> list[tuple[str, int, int]]:
    """Spans of a whole text's tags."""
    out, at, kind = [], None, None
    edges = [*np.flatnonzero(tags).tolist()]
    for i in edges:
        k, begins = (int(tags[i]) - 1) // 2, tags[i] % 2 == 1
        if at is not None and not begins and k == kind and i == end:  # noqa: F821
            end = i + 1
            continue
        if at is not None:
            out.append((KINDS[kind], at, end))
        at, kind, end = i, k, i + 1
    if at is not None:
        out.append((KINDS[kind], at, end))
    return out


def reconcile(text: str, base: list[tuple[str, int, int]], tagged: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Base spans and those tagged ones that may be added, in the order of the base."""
    taken = [(a, b) for _, a, b in base]
    added = []
    for kind, a, b in sorted(tagged, key=lambda s: (s[1] - s[2], s[1])):
        if all(b <= x or a >= y for x, y in taken) and plausible(kind, text[a:b], text[a - 1:a] if a else "", text[b:b + 1]):
            added.append((kind, a, b))
            taken.append((a, b))
    return sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0])))


def tag(texts: list[str], tagger: Tagger | None) -> list[list[tuple[str, int, int]]]:
    """All spans of each text."""
    base = [base_spans(t) for t in texts]
    if tagger is None:
        return base
    todo = [(i, at) for i, t in enumerate(texts) for at in windows_of(t)]
    tags = {i: np.zeros(len(texts[i]), np.int8) for i, _ in todo}
    quarter = (WINDOW - STRIDE) // 2
    for a in range(0, len(todo), DECODED):
        some = todo[a:a + DECODED]
        got = tagger.decode(np.stack([encode(texts[i][at:at + WINDOW], WINDOW) for i, at in some]))
        for (i, at), row in zip(some, got, strict=True):
            lo = 0 if at == 0 else quarter                # outer quarters belong to the neighbours
            hi = WINDOW if at + WINDOW >= len(texts[i]) else WINDOW - quarter
            part = tags[i][at + lo:at + hi]
            part[:] = row[lo:hi][:len(part)]
    return [reconcile(t, b, joined(tags[i])) if i in tags else b for i, (t, b) in enumerate(zip(texts, base, strict=True))]


def _find(tagger: Tagger | None):
    def run(batches):
        for batch in few_rows(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            spans = tag(texts, tagger)
            base = [base_spans(t) if s else [] for t, s in zip(texts, spans, strict=True)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            made = [pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in x], kind) for x in (base, spans)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made, *batch.columns[2:]],
                                             names=["id", "base", "spans", *batch.schema.names[2:]])
    return run


_SPANS = "array<struct<kind:string,start:int,end:int>>"


def find_personal_data(docs: DataFrame, tagger: Tagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id, base, spans`` (code points, end exclusive)."""
    ins = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return ins.mapInArrow(_find(tagger), f"id long, base {_SPANS}, spans {_SPANS}")


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind; where spans overlap, by the first one's."""
    out, at = [], 0
    for kind, a, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame, tagger: Tagger | None, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, with personal data in the text replaced; null stays null."""
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in few_rows(batches):
            texts = batch.column(place).to_pylist()
            spans = tag([t or "" for t in texts], tagger)
            new = [t if not s else redacted(t, s) for t, s in zip(texts, spans, strict=True)]
            columns = list(batch.columns)
            columns[place] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
    return docs.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(run, docs.withColumn(text_col, F.col(text_col).cast("string")).schema)


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: ``doc_id``, base counts by kind, ``base_sha256`` and ``spans``."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = find_personal_data(docs, learn(docs))
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) AS long) AS n_{k}") for k in KINDS]
    return out.select(F.col("id").alias("doc_id"), *counts, F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"))
