"""Language identification by hyperdimensional profiles (operator 2).

Each letter has a random vector of +1 and -1, drawn from its code point.  The
vector of a letter trigram binds three of them: the first as it is, the second
rotated by one place, the third by two, multiplied place by place.  A text's
profile bundles (sums) the vectors of its trigrams; a language's prototype
bundles those of all learned texts of that language.  A text gets the language
whose prototype has the largest cosine with its profile.

Binding is done once per distinct trigram of a block of texts, and bundling is a
product of trigram counts and bound vectors, so the cost follows the text.

A trigram is taken within a run of letters with a blank at either end.  Letters
are those of ``str.isalpha``, lower-cased where that gives one character.  A text
that is null or has no letter is ``und`` with score 0; so is every text
if nothing could be learned.  Every row gives one row, whatever its id.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moderato.llm.common import documents
from moderato.llm.textbytes import blocks, few_rows

DIM = 1024
SEED = 20260
FOLDS = 5
BLOCK_CHARS = 100_000     # text whose trigrams are bound together
BLOCK_ROWS = 64
UNDETERMINED = "und"


@functools.cache
def _letter(code: int, dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, code]).integers(0, 2, dim).astype(np.float32) * 2 - 1


def _bound(grams: np.ndarray, dim: int) -> np.ndarray:
    """The vectors of trigrams, each three code points in one integer."""
    out = None
    for shift in range(3):
        codes, where = np.unique((grams >> np.uint64(21 * (2 - shift))) & np.uint64(0x1FFFFF), return_inverse=True)
        table = np.stack([np.roll(_letter(c, dim), shift) for c in codes.tolist()])
        out = table[where] if out is None else np.multiply(out, table[where], out=out)
    return out


@functools.cache
def _folded() -> np.ndarray:
    """Per code point its lower-case letter; 0 for anything but a letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000 or not chr(c).isalpha():
            continue
        low = chr(c).lower()
        table[c] = ord(low) if len(low) == 1 else c
    return table


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Row and trigram of each occurrence in the texts."""
    joined = "\0".join((x or "").replace("\0", " ") for x in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.cumsum(np.append(0, codes == 0))[:-1] if len(codes) else np.zeros(0, np.int64)
    low = _folded()[codes]
    letter = low > 0
    # Blanks stand for every run of other characters: keep those next to a letter.
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = np.where(letter, low, np.uint32(32)).astype(np.uint64)
    pad = np.concatenate([[32], low, [32]]).astype(np.uint64)
    here = np.flatnonzero(letter)          # the trigram around each letter: before, it, after
    grams = (pad[here] << np.uint64(42)) | (pad[here + 1] << np.uint64(21)) | pad[here + 2]
    return row[here], grams


def _text_blocks(texts: list[str | None], rows: int = BLOCK_ROWS):
    sizes = np.cumsum([0] + [len(x or "") for x in texts])
    for a, b in blocks(sizes, BLOCK_CHARS):
        for i in range(a, b, rows):
            yield i, min(b, i + rows)


def _bundles(dim: int):
    """Per task and language: the bundle of all its texts' trigrams."""
    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in few_rows(batches, 4096):
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in _text_blocks(texts, 1 << 20):
                row, grams = trigrams(texts[a:b])
                if not len(row):
                    continue
                names = sorted({x for x in langs[a:b]})
                code = np.array([names.index(x) for x in langs[a:b]])
                gram, where = np.unique(grams, return_inverse=True)
                counts = np.bincount(code[row] * len(gram) + where, minlength=len(names) * len(gram))
                counts = counts.reshape(len(names), -1)
                exact = np.float32 if counts.sum(axis=1).max() < 1 << 24 else np.float64     # sums of so many +-1
                made = (counts.astype(exact) @ _bound(gram, dim).astype(exact, copy=False)).astype(np.int64)
                for i, x in enumerate(names):
                    total[x] = total.get(x, 0) + made[i]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))],
            names=["lang", "bundle"])
    return run


def prototypes(labelled: DataFrame, dim: int = DIM) -> dict[str, np.ndarray]:
    """Unit prototypes by language from all rows of ``text, lang``.

    Bundles are summed place by place on the executors; one vector per
    language comes to the driver."""
    parts = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang").mapInArrow(
        _bundles(dim), "lang string, bundle array<bigint>")
    summed = (parts.select("lang", F.posexplode("bundle").alias("place", "x")).groupBy("lang", "place")
              .agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "x"))).alias("v")))
    rows = summed.select("lang", F.col("v.x").alias("x")).collect()
    out = {}
    for r in sorted(rows, key=lambda r: r["lang"]):
        v = np.array(r["x"], np.float64)
        if v.any():
            out[r["lang"]] = v / np.linalg.norm(v)
    return out


def _predict(dim: int, names: list[str], protos: np.ndarray, columns: list[str]):
    """The text is the last column; it gives way to the prediction."""
    def run(batches):
        for batch in few_rows(batches):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            for a, b in _text_blocks(texts) if names else ():
                row, grams = trigrams(texts[a:b])
                if not len(row):
                    continue
                gram, where = np.unique(grams, return_inverse=True)
                counts = np.bincount(row * len(gram) + where, minlength=(b - a) * len(gram)).reshape(b - a, -1)
                profile = counts.astype(np.float32) @ _bound(gram, dim)
                cosine = profile @ protos.T / np.maximum(np.linalg.norm(profile, axis=1), 1e-9)[:, None]
                best = cosine.argmax(axis=1)
                for i in np.unique(row).tolist():
                    lang[a + i] = names[best[i]]
                    score[a + i] = min(1.0, max(0.0, float(cosine[i, best[i]])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=columns)
    return run


def predict_language(docs: DataFrame, learned: dict[str, np.ndarray], text_col: str = "text", lang_out: str = "lang_pred",
                     score_out: str = "score", dim: int = DIM) -> DataFrame:
    """All rows and columns of ``docs`` with the predicted language and its
    cosine (0 to 1).  ``lang_out`` and ``score_out`` replace columns of those names."""
    names = list(learned)
    protos = np.stack([learned[x] for x in names]).astype(np.float32) if names else np.zeros((0, dim), np.float32)
    kept = [c for c in docs.columns if c not in (lang_out, score_out)]
    ins = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("string").alias(unused(docs, "text")))
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])
    return ins.mapInArrow(_predict(dim, names, protos, [*kept, lang_out, score_out]), schema)


def unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def held_out(id_col: Column) -> Column:
    """Rows that aren't learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def learn_from(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Prototypes from the rows that aren't held out."""
    return prototypes(docs.filter(~held_out(F.col(id_col))).select(F.col(text_col).cast("string").alias("text"),
                                                                   F.col(lang_col).cast("string").alias("lang")))


def op2_hd_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``."""
    docs = documents(spark, sf_dir)
    out = predict_language(docs.select("doc_id", "text"), learn_from(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

