"""Embedding near-duplicates by int8 tile products (operator 4).

Equal vectors form one class; only its smallest id goes on, with the class's size.

A unit vector u is held as a scale s and int8 codes q, with the exact length e of the
error u - s q.  Since |s q| <= 1 + e, a product of two differs from that of their
codes by at most e1 (1 + e2) + e2.  Pairs whose bound stays below the threshold are
dismissed, those above it for certain are links, and only the pairs between are
recomputed in double precision.  Integer products are exact in float32 for up
to 1024 places, which are multiplied at a time.

Tiles.  A vector goes to the nearest of the pivots (one for each tile's worth of
vectors, 256 at most, taken by hash), and each pivot's vectors are dealt
out over tiles of about ``TILE`` rows.  A pair of tiles is left out only if the angle between
their centres, less both radii, is beyond the threshold's.  Every other pair
is one task, which returns for each vector its number of links and the smallest id it
reaches inside the pair of tiles: never the links themselves.  What all tile pairs
return is joined by connected components.

Vectors that are null, empty, zero or hold null or non-finite values, and
vectors of another length than their partner, link with nothing.  Where
rows repeat an id, the smallest vector stands for them, in one row.  A row with a
null id has no links and a null component.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moderato.llm.common import components, stage

THRESHOLD = 0.95
TILE = 4096
MAX_PIVOTS = 256
SLACK = 1e-9          # far above the rounding of double products, far below the bounds
EXACT_PLACES = 1024   # 127 * 127 * 1024 < 2**24


def _vector(x) -> np.ndarray | None:
    """In double precision; None if it can't link."""
    if x is None or len(x) == 0 or any(v is None for v in x):
        return None
    v = np.asarray(x, np.float64)
    return v if np.isfinite(v).all() and v.any() else None


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=-1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=-1, keepdims=True))


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    return [_vector(x) for x in column.to_pylist()]


def _digests(batches):
    for batch in batches:
        found = _vectors(batch.column(1))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([None if v is None else hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in found],
                                       pa.binary())], names=["id", "digest"])


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales and error lengths (rounded up) of unit rows."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    off = unit - codes * scale[:, None]
    return codes, scale, np.sqrt((off * off).sum(axis=1)) * (1 + 1e-12) + 1e-15


def _nearest(pivots: dict[int, np.ndarray]):
    def run(batches):
        for batch in batches:
            found = _vectors(batch.column(1))
            dims = [len(v) for v in found]
            cell = [int((pivots[len(v)] @ _unit(v)).argmax()) if len(v) in pivots else 0 for v in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(1), pa.array(dims, pa.int32()),
                                              pa.array(cell, pa.int32())], names=["id", "copies", "v", "dim", "cell"])
    return run


_TILE = "tile long, dim int, rows int, centre array<double>, radius double, ids binary, copies binary, vectors binary"


def _tile(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("id")
    vectors = np.stack([np.asarray(v, np.float64) for v in pdf["v"]])
    unit = _unit(vectors)
    centre = unit.mean(axis=0)
    size = np.sqrt(centre @ centre)
    centre = centre / size if size > 1e-6 else unit[0]
    radius = float(np.arccos(np.clip(unit @ centre, -1, 1)).max())
    return pd.DataFrame({"tile": [pdf["tile"].iloc[0]], "dim": [vectors.shape[1]], "rows": [len(pdf)], "centre": [centre.tolist()],
                         "radius": [radius], "ids": [pdf["id"].to_numpy(np.int64).tobytes()],
                         "copies": [pdf["copies"].to_numpy(np.int64).tobytes()], "vectors": [vectors.tobytes()]})


def _linked(x: np.ndarray, y: np.ndarray, threshold: float, strip: int = 512):
    """Row and column of every pair of rows of ``x`` and ``y`` that links."""
    ux, uy = _unit(x), _unit(y)
    (qx, sx, ex), (qy, sy, ey) = quantise(ux), quantise(uy)
    wide = [slice(a, a + EXACT_PLACES) for a in range(0, x.shape[1], EXACT_PLACES)]
    qy = [qy[:, w].astype(np.float32).T for w in wide]
    nx, ny = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
    plain = np.isfinite(nx).all() and np.isfinite(ny).all() and nx.min() > 1e-100 and ny.min() > 1e-100
    for a in range(0, len(x), strip):
        part = slice(a, a + strip)
        near = sum(qx[part, w].astype(np.float32) @ q for w, q in zip(wide, qy, strict=True)).astype(np.float64)
        near *= sx[part, None]
        near *= sy
        bound = ex[part, None] * (1 + ey) + ey
        i, j = np.nonzero(near + bound >= threshold - SLACK)
        sure = near[i, j] - bound[i, j] >= threshold + SLACK
        doubt = np.flatnonzero(~sure)
        for b in range(0, len(doubt), 1 << 16):
            at = doubt[b:b + (1 << 16)]
            p, q = i[at] + a, j[at]
            if plain:
                cosine = np.einsum("ij,ij->i", x[p], y[q]) / (nx[p] * ny[q])
            else:
                cosine = np.einsum("ij,ij->i", ux[p], uy[q])
            sure[at] = cosine >= threshold
        yield i[sure] + a, j[sure]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Per node 0..n-1 the smallest node that it reaches."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        was = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if np.array_equal(was, root):
            return root


def _compare(threshold: float):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                same = r["a"] == r["b"]
                ids = [np.frombuffer(r[k], np.int64) for k in (("a_ids",) if same else ("a_ids", "b_ids"))]
                copies = [np.frombuffer(r[k], np.int64) for k in ("a_copies", "b_copies")]
                x, y = (np.frombuffer(r[k], np.float64).reshape(-1, r["dim"]) for k in ("a_vectors", "b_vectors"))
                all_ids, shift = np.concatenate(ids), 0 if same else len(x)
                links, ends = np.zeros(len(all_ids), np.int64), []
                for i, j in _linked(x, y, threshold):
                    if same:
                        i, j = i[i != j], j[i != j]
                    np.add.at(links, i, copies[1][j])
                    if not same:
                        np.add.at(links, j + shift, copies[0][i])
                    ends.append((i.astype(np.int32), (j + shift).astype(np.int32)))
                order = np.argsort(all_ids, kind="stable")      # nodes in the order of ids, so that the smallest wins
                rank = np.empty_like(order)
                rank[order] = np.arange(len(order))
                root = all_ids[order][_roots(len(order), *(rank[np.concatenate([e[k] for e in ends])] for k in (0, 1)))][rank]
                has = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(all_ids[has]), pa.array(links[has]), pa.array(root[has])],
                                                 names=["id", "links", "root"])
    return run


def _pivots(heads: DataFrame, tile: int) -> dict[int, np.ndarray]:
    """For each vector length a bounded sample, by hash, of one vector a tile."""
    out = {}
    for r in heads.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).limit(64).collect():
        k = min(MAX_PIVOTS, -(-r["n"] // tile))
        rows = heads.filter(F.size("v") == r["dim"]).orderBy(F.xxhash64("id"), "id").limit(k).collect()
        out[r["dim"]] = np.stack([_unit(np.asarray(x["v"], np.float64)) for x in rows])
    return out


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD,
                    tile: int = TILE) -> DataFrame:
    """``id, links, component`` for every row: how many other rows it links with at
    a cosine of ``threshold`` or more, and the smallest id reachable."""
    spark = vectors.sparkSession
    every = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    if every.groupBy("id").count().filter("count > 1 AND id IS NOT NULL").head(1):
        every = every.filter("id IS NULL").unionByName(every.filter("id IS NOT NULL").groupBy("id").agg(F.min("v").alias("v")))
    marked = stage(every.mapInArrow(_digests, "id long, digest binary"), "digests")
    classes = marked.filter("digest IS NOT NULL AND id IS NOT NULL").groupBy("digest").agg(
        F.min("id").alias("head"), F.count(F.lit(1)).alias("copies"))
    classes = stage(classes, "classes")
    heads = stage(every.join(classes.select(F.col("head").alias("id"), "copies"), "id").select("id", "v", "copies"), "heads")
    pivots = _pivots(heads, tile)
    celled = heads.mapInArrow(_nearest(pivots), "id long, copies long, v array<double>, dim int, cell int")
    sizes = sorted(tuple(r) for r in celled.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n")).collect())
    first, at = [], 0
    for dim, cell, n in sizes:
        first.append((dim, cell, at, -(-n // tile)))
        at += -(-n // tile)
    first_df = spark.createDataFrame(first, "dim int, cell int, first long, tiles int")
    tiled = celled.join(F.broadcast(first_df), ["dim", "cell"]).select(
        "id", "copies", "v", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("tiles"))).alias("tile"))
    tiles = stage(tiled.groupBy("tile").applyInPandas(_tile, _TILE), "tiles")

    centres = tiles.select(F.col("tile").alias("b"), F.col("dim").alias("b_dim"), F.col("centre").alias("b_centre"), F.col("radius").alias("b_radius"))
    pairs = (tiles.select(F.col("tile").alias("a"), "dim", "centre", "radius", F.explode(F.sequence(F.col("tile"), F.lit(at - 1).cast("long"))).alias("b"))
             .join(centres, "b").filter("dim = b_dim"))
    dot = F.aggregate(F.zip_with("centre", "b_centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))) - F.col("radius") - F.col("b_radius")
    pairs = pairs.filter((F.col("a") == F.col("b")) | (apart <= math.acos(threshold) + 1e-6)).select("a", "b")
    body = lambda e: tiles.select(F.col("tile").alias(e), *[F.col("dim")] * (e == "a"), *[F.col(c).alias(f"{e}_{c}") for c in ("ids", "copies", "vectors")])
    found = stage(pairs.join(body("a"), "a").join(body("b"), "b").mapInArrow(_compare(threshold), "id long, links long, root long"), "links")
    joined = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    heads_out = (classes.join(counts, F.col("head") == counts["id"], "left").drop("id").join(joined, F.col("head") == F.col("node"), "left")
                 .select("digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "head").alias("component")))
    return marked.join(heads_out, "digest", "left").select(
        "id", F.when(F.col("id").isNull(), 0).otherwise(F.coalesce("links", F.lit(0))).cast("long").alias("links"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept`` at a cosine of 0.95."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select(F.col("id").alias("vec_id"), F.col("links").alias("n_links"), F.col("component").alias("component_id"),
                      F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))


OP4_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id <> y.vec_id AND x.n > 0 AND y.n > 0
      AND list_dot_product(x.e, y.e) / (x.n * y.n) >= 0.95),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links,
  (SELECT min(r.b) FROM r WHERE r.a = e.vec_id) AS component_id,
  e.vec_id = (SELECT min(r.b) FROM r WHERE r.a = e.vec_id) AS kept
FROM embeddings e
"""
