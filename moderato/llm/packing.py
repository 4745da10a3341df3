"""Bulk-synchronous best-fit packing of token sequences (operator 9).

Tokens.  A document is its token ids and then ``end_id``; null text is empty.  One
longer than ``seq_len`` is cut into pieces of ``seq_len``, of which the first may be
shorter, so a document has one piece at most that needs a partner.

Packing.  Full pieces are sequences by themselves.  The others and the
gaps of open sequences are range-sorted together, largest first, and every superstep
makes one successor sweep over that order:  each gap raises a balance by one, each
piece lowers it, so a piece and the smallest gap that still holds it meet at
the same level of the balance, next to each other.  Positions come from one small
histogram (sizes by kind and salt) and ranks within its cells;  levels are
window partitions of a few rows, since the balance crosses a level at most once per
size.  Conflicts are thus settled by rank:  the k-th piece of a size gets the k-th
free gap.  Placed pieces shrink their gaps, and the next superstep starts.

Pieces of more than half a sequence open one each at the start.  When a sweep could
place nothing, as many sequences as the rest fills are opened by the largest pieces.
Pieces up to 1/32 of a sequence are first strung together, in order of
size, to runs of about 1/8, which bounds the number of supersteps
however small the documents are.

A third of all documents may have one length:  ranks are taken within salted
cells.  Empty tables give no rows;  repeated ids are packed row by row.
"""

from __future__ import annotations

import functools
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from moderato.llm.common import documents, stage

SEQ_LEN = 1024
END_ID = 2
SALTS = 16
CACHED_PIECES = 400_000      # words kept with their ids in a task
TOKENIZER = "byte_bpe_50k.json"

_PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>"


class ByteBpe:
    """Token ids, as bytes of unsigned 32-bit numbers, of a byte-level BPE file
    of ``tokenizers``, without special tokens around the text.

    The file's vocabulary and splitting pattern do the merges; words met
    before come from a bounded cache.  Between two characters that aren't white space, a
    single blank always starts a new part, so a text can be cut there."""

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer
        self.exact = Tokenizer.from_file(path)
        special = {t.content: i for i, t in self.exact.get_added_tokens_decoder().items()}
        letters = [*range(33, 127), *range(161, 173), *range(174, 256)]     # bytes that stand for themselves
        rest = [b for b in range(256) if b not in letters]
        to_byte = {chr(b): b for b in letters} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(to_byte[c] for c in t): i for t, i in self.exact.get_vocab().items() if t not in special}
        self.merge = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.special, self.known = tuple(special), {}

    def _raw(self, text: str) -> bytes:
        return array("I", self.merge(text)).tobytes()

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return array("I", self.exact.encode(text, add_special_tokens=False).ids).tobytes()
        words = text.split(" ")
        if len(words) < 3 or not all(w and not w[0].isspace() and not w[-1].isspace() for w in words):
            return self._raw(text)
        known = self.known
        if len(known) > CACHED_PIECES:
            known.clear()
        out = [self._raw(words[0])]
        for w in words[1:]:
            got = known.get(w)
            if got is None:
                got = known[w] = self._raw(" " + w)
            out.append(got)
        return b"".join(out)


@functools.cache
def _tokenizer(name: str) -> ByteBpe:
    import public_tokenizers
    return ByteBpe(name if "/" in name else public_tokenizers.path(name))


def cut(length: int, seq_len: int) -> list[tuple[int, int]]:
    """Start and length of each piece."""
    first = length % seq_len or seq_len if length > seq_len else length
    return [(0, first), *((s, seq_len) for s in range(first, length, seq_len))]


def _tokenise(name: str, seq_len: int, end_id: int, with_ids: bool):
    end = array("I", [end_id]).tobytes()

    def run(batches):
        bpe, at = _tokenizer(name), TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = ([], [], [], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = bpe.ids(text or "") + end
                for piece, (start, length) in enumerate(cut(len(raw) // 4, seq_len)):
                    part = raw[4 * start:4 * (start + length)]
                    at += 1
                    for column, x in zip(rows, (at, doc_id, piece, start, length, zlib.crc32(part),
                                                np.frombuffer(part, np.int32) if with_ids else None), strict=True):
                        column.append(x)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)],
                                             names=["uid", "doc_id", "piece", "start", "length", "ids_crc32", "ids"])
    return run


def tokenise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, seq_len: int = SEQ_LEN,
             end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of every row, with their ids if asked for."""
    ins = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return ins.mapInArrow(_tokenise(tokenizer, seq_len, end_id, with_ids), _PIECES)


def _cells(items: DataFrame) -> dict:
    """Rows by kind, size and salt: at most 2 x seq_len x SALTS numbers."""
    rows = items.groupBy("kind", "size", "salt").agg(F.count(F.lit(1)).alias("n")).collect()
    return {(r["kind"], r["size"], r["salt"]): r["n"] for r in rows}


def _ranked(items: DataFrame, first: list[tuple]) -> DataFrame:
    """``rank`` of each row: the first rank of its cell and its place there."""
    cells = F.broadcast(items.sparkSession.createDataFrame(first, "kind int, size long, salt int, first long"))
    own = Window.partitionBy("kind", "size", "salt").orderBy("item")
    return items.withColumn("at", F.row_number().over(own)).join(cells, ["kind", "size", "salt"])


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALTS)).cast("int"))


def _string_together(pieces: DataFrame, seq_len: int) -> DataFrame:
    """``uid, item, inside, size``: small pieces as parts of runs, others alone."""
    small, run = seq_len // 32, seq_len // 8
    alone = pieces.filter(F.col("length") > small).select("uid", F.col("uid").alias("item"), F.lit(0).cast("long").alias("inside"),
                                                          F.col("length").alias("size"))
    if not small:
        return alone
    tiny = _salted(pieces.filter(F.col("length") <= small).select(F.lit(0).alias("kind"), F.col("uid").alias("item"),
                                                                  F.col("length").alias("size")))
    cells, first, total = _cells(tiny), [], 0
    for key in sorted(cells):
        first.append((*key, total))
        total += cells[key] * key[1]
    start = _ranked(tiny, first).select("item", "size", (F.col("first") + (F.col("at") - 1) * F.col("size")).alias("start"))
    own = Window.partitionBy("run")
    runs = start.withColumn("run", F.floor(F.col("start") / run)).select(
        F.col("item").alias("uid"), F.min("item").over(own).alias("item"),
        (F.col("start") - F.min("start").over(own)).alias("inside"), F.sum("size").over(own).alias("size"))
    return alone.unionByName(runs)


def _superstep(cells: dict, seq_len: int) -> tuple[list, list, int]:
    """From the histogram: the balance before each cell; how many pieces would be
    left over; and from which size pieces open sequences, with how many of that size.

    Sizes go down; gaps come before pieces of their size."""
    firsts, balance, low = [], 0, 0
    order = sorted(cells, key=lambda c: (-c[1], -c[0], c[2]))
    for kind, size, salt in order:
        n = cells[kind, size, salt]
        firsts.append((kind, size, salt, balance))
        balance += n if kind else -n
        low = min(low, balance)
    placed = sum(n for (kind, _, _), n in cells.items() if not kind) + low
    need = 0
    if not placed:
        docs = sorted(((size, n) for (kind, size, _), n in cells.items() if not kind), reverse=True)
        need = max(-(-sum(s * n for s, n in docs) // seq_len), sum(n for s, n in docs if 2 * s > seq_len))
    return firsts, order, need


def best_fit(items: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """``item, sequence_id, offset`` for every ``item, size`` (unique ids, sizes
    below ``seq_len``).  Sequences are named after the item that opens them."""
    state = stage(_salted(items.select(F.lit(0).alias("kind"), "item", "size", F.lit(None).cast("long").alias("sequence_id"),
                                       F.lit(None).cast("long").alias("offset"))), "fit")
    done = None
    while True:
        open_ = state.filter("kind < 2")
        cells = _cells(open_)
        if not any(kind == 0 for kind, _, _ in cells):
            break
        firsts, order, need = _superstep(cells, seq_len)
        if need:        # nothing fits: the largest pieces open sequences
            before, run = [], 0
            for key in order:
                if key[0] == 0:
                    before.append((*key, run))
                    run += cells[key]
            ranked = _ranked(open_.filter("kind = 0"), before)
            opens = F.col("first") + F.col("at") <= need
            stays = F.struct("kind", "item", "size", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))
            now = ranked.select(F.explode(F.when(opens, F.array(
                F.struct(F.lit(2).alias("kind"), "item", "size", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset")),
                F.struct(F.lit(1).alias("kind"), "item", (seq_len - F.col("size")).alias("size"), F.col("item").alias("sequence_id"),
                         F.lit(None).cast("long").alias("offset")))).otherwise(F.array(stays))).alias("x")).select("x.*")
            now = now.unionByName(open_.filter("kind = 1").drop("salt"))
        else:
            up = F.col("kind") == 1
            level = F.when(up, F.col("first") + F.col("at") - 1).otherwise(F.col("first") - F.col("at"))
            swept = _ranked(open_, firsts).withColumn("level", level)
            near = Window.partitionBy("level").orderBy(F.desc("size"), F.desc("kind"), "salt", "at")
            gap, nxt = F.lag(F.struct("kind", "size", "sequence_id")).over(near), F.lead("kind").over(near)
            swept = swept.withColumn("gap", gap).withColumn("next", nxt)
            fits = F.expr("kind = 0 AND gap.kind = 1")
            lives = F.expr("kind = 0 OR next IS NULL OR next = 1")      # a gap that was taken comes back with its piece
            null = F.lit(None).cast("long")
            now = swept.filter(lives | fits).select(F.explode(F.when(fits, F.array(
                F.struct(F.lit(2).alias("kind"), "item", "size", F.col("gap.sequence_id").alias("sequence_id"),
                         (seq_len - F.col("gap.size")).alias("offset")),
                F.struct(F.lit(1).alias("kind"), F.col("gap.sequence_id").alias("item"), (F.col("gap.size") - F.col("size")).alias("size"),
                         F.col("gap.sequence_id").alias("sequence_id"), null.alias("offset"))))
                .otherwise(F.array(F.struct("kind", "item", "size", "sequence_id", null.alias("offset"))))).alias("x")).select("x.*")
        least = min(size for (kind, size, _) in cells if not kind)
        state = stage(_salted(now.filter(F.expr(f"kind <> 1 OR size >= {least}"))), "fit")
        placed = state.filter("kind = 2").select("item", "sequence_id", "offset")
        done = placed if done is None else done.unionByName(placed)
    empty = state.filter("kind = 2").select("item", "sequence_id", "offset")
    return empty.limit(0) if done is None else done


def pack(pieces: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """The pieces (``uid``, ``length``) with ``sequence_id`` and ``offset``."""
    short = pieces.filter(F.col("length") < seq_len).select("uid", "length")
    strung = stage(_string_together(short, seq_len), "strung")
    items = strung.filter("inside = 0").select("item", "size")
    fitted = best_fit(items, seq_len)
    where = strung.join(fitted, "item").select("uid", "sequence_id", (F.col("offset") + F.col("inside")).alias("offset"))
    whole = pieces.filter(F.col("length") >= seq_len)
    return (pieces.filter(F.col("length") < seq_len).join(where, "uid")
            .unionByName(whole.withColumn("sequence_id", F.col("uid")).withColumn("offset", F.lit(0).cast("long"))))


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence, from pieces packed with their ids."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, seq_len: int = SEQ_LEN,
                   end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenised, cut and packed rows of ``docs``."""
    pieces = tokenise(docs, id_col, text_col, tokenizer, seq_len, end_id, with_ids)
    pieces = stage(pieces if with_ids else pieces.drop("ids"), "pieces")
    return pack(pieces, seq_len)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    return pack_documents(documents(spark, sf_dir)).drop("uid")
