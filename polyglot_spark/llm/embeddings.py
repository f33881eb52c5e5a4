"""Embedding near-dedup: int8 tile products with rigorous error bounds.

Vectors are scaled to length one and rounded to 8-bit integers, each with its own step;
what the rounding left is rounded to 8-bit integers once more.  Tiles travel as those
integers with the lengths of both rounding errors, which bound how far the products of
rounded vectors differ from the true cosine.  The first integers settle almost all pairs
of two tiles, both together nearly all of the rest, and only pairs whose bound still
reaches the threshold are computed from the full vectors, brought to them by joins.
Equal vectors are compared once, with their number.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut

TILE = 8192


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, usable): the vector as doubles; not usable if null, empty, zero or with a null or non-finite component."""
    v = F.col("embedding").cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select("vec_id", v.alias("v"), F.coalesce(sound, F.lit(False)).alias("usable"))


def record(size: int) -> np.dtype:
    """A vector in a tile: its key and copies, its step, the lengths of both rounding errors, and its integers."""
    return np.dtype([("key", "<i8"), ("copies", "<i8"), ("step", "<f8"), ("error", "<f8"), ("rest", "<f8"), ("q", "i1", (size,)), ("r", "i1", (size,))])


def quantised(x: np.ndarray) -> np.ndarray:
    """Unit rows as records without keys."""
    rows = np.zeros(len(x), record(x.shape[1]))
    step = np.abs(x).max(1) / 127
    q = np.rint(x / step[:, None])
    left = x - q * step[:, None]
    r = np.clip(np.rint(left / step[:, None] * 254), -127, 127)
    rows["step"], rows["q"], rows["r"] = step, q, r
    rows["error"] = np.linalg.norm(left, axis=1) + 1e-12
    rows["rest"] = np.linalg.norm(left - r * (step[:, None] / 254), axis=1) + 1e-12
    return rows


def tile_links(x: np.ndarray, y: np.ndarray | None, threshold: float, rows: int = 512):
    """Index pairs (i, j, sure) of records that link, or may (not sure); within ``x`` (i < j) if ``y`` is None."""
    same = y is None
    y = x if same else y
    near_y = y["q"].astype(np.float32) * y["step"].astype(np.float32)[:, None]
    widest, slack = y["error"].max(), 1e-4 + 2e-7 * y["q"].shape[1]  # the latter covers single precision
    for at in range(0, len(x), rows):
        part = x[at : at + rows]
        near = (part["q"].astype(np.float32) * part["step"].astype(np.float32)[:, None]) @ near_y.T
        most = part["error"].max()
        i, j = np.nonzero(near >= np.float32(threshold - (most + (1 + most) * widest + slack)))
        value, i = near[i, j].astype(float), i + at
        if same:
            above = j > i
            value, i, j = value[above], i[above], j[above]
        bound = x["error"][i] + (1 + x["error"][i]) * y["error"][j] + slack
        sure = value - bound >= threshold
        if sure.any():
            yield i[sure], j[sure], True
        open_ = np.flatnonzero((value + bound >= threshold) & ~sure)
        for k in range(0, len(open_), 1 << 14):
            a, b = i[open_[k : k + (1 << 14)]], j[open_[k : k + (1 << 14)]]
            u, v = (t["step"][:, None] * (t["q"] + t["r"] / 254) for t in (x[a], y[b]))
            value = np.einsum("ij,ij->i", u, v)
            bound = x["rest"][a] + (1 + x["rest"][a]) * y["rest"][b] + 1e-12
            for sure, some in ((True, value - bound >= threshold), (False, (value + bound >= threshold) & (value - bound < threshold))):
                if some.any():
                    yield a[some], b[some], sure


def packed_tile(table: pa.Table) -> pa.Table:
    """Task body: the vectors of a tile, scaled to length one and rounded, as one binary value."""
    size = table["size"][0].as_py()
    x = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    x = x / np.abs(x).max(1)[:, None]
    rows = quantised(x / np.linalg.norm(x, axis=1)[:, None])
    rows["key"], rows["copies"] = table["key"].to_numpy(), table["copies"].to_numpy()
    return pa.table({"size": pa.array([size], pa.int32()), "tile": table["tile"].slice(0, 1), "m": pa.array([rows.tobytes()], pa.binary())})


def met_tiles(threshold: float):
    """Task body: for each pair of tiles (a, b, links, sure): a member, another of its part and its sure links, or an open pair."""

    def work(frames):
        for frame in frames:
            for size, x, y in zip(frame["size"].to_pylist(), frame["x"], frame["y"], strict=True):
                x, y = np.frombuffer(x.as_buffer(), record(size)), np.frombuffer(y.as_buffer(), record(size)) if y.is_valid else None
                other, shift = (x, 0) if y is None else (y, len(x))
                keys = x["key"] if y is None else np.concatenate([x["key"], y["key"]])
                count, tops, open_ = np.zeros(len(keys), np.int64), list(range(len(keys))), [np.zeros((0, 2), np.int64)]
                for i, j, sure in tile_links(x, y, threshold):
                    if sure:
                        np.add.at(count, i, other["copies"][j])
                        np.add.at(count, j + shift, x["copies"][i])
                        forest(tops, i, j + shift)
                    else:
                        open_.append(np.stack([x["key"][i], other["key"][j]], 1))
                some = np.flatnonzero(count)
                top = np.array([find(tops, k) for k in some.tolist()], np.int64)
                open_ = np.concatenate(open_)
                columns = [np.concatenate([keys[some], open_[:, 0]]), np.concatenate([keys[top], open_[:, 1]]), np.concatenate([count[some], np.zeros(len(open_), np.int64)])]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.arange(len(columns[0])) < len(some))], ["a", "b", "links", "sure"])

    return work


def cosine(a, b) -> F.Column:
    """Cosine of two arrays of doubles, scaled first so that no square overflows."""
    scaled = lambda v: F.transform(v, lambda x: x / F.array_max(F.transform(v, F.abs)))
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    a, b = scaled(a), scaled(b)
    return dot(a, b) / F.sqrt(dot(a, a)) / F.sqrt(dot(b, b))


def near_vectors(vectors: DataFrame, threshold: float = 0.9, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector.

    Every two tiles meet in a task of their own; it returns counts and a spanning set
    of links of its members, never the pairs.

    Defined results: vectors that are null, empty, zero or hold a null or non-finite
    component link with nothing; vectors of different lengths do not link; repeated
    rows are links of each other; a vector without links is its own component; one
    without an id is linked and counted like any other, and a component of such vectors
    alone has a null id; no rows give no rows; further columns are ignored.
    """
    rows = cut(usable(vectors))
    # equal vectors have cosine one: one of them stands for all
    distinct = rows.where("usable").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    distinct = cut(distinct.withColumns({"size": F.size("v"), "key": F.monotonically_increasing_id()}))
    tiles = max(1, math.ceil(distinct.count() / tile))
    number = F.pmod(F.xxhash64("v", F.lit(1)), F.lit(tiles)).cast("int")
    members = distinct.withColumn("tile", number).groupBy("size", "tile")
    packed = cut(members.applyInArrow(packed_tile, "size int, tile int, m binary"))  # about `tile` vectors each
    left = packed.withColumn("other", F.explode(F.sequence("tile", F.lit(tiles - 1)))).withColumnRenamed("m", "x")
    right = packed.select("size", F.col("tile").alias("other"), F.col("m").alias("y"))
    pairs = left.join(right, ["size", "other"]).select("size", "tile", "other", "x", F.when(F.col("tile") != F.col("other"), F.col("y")).alias("y"))
    pairs = pairs.repartition(max(1, min(20_000, tiles * (tiles + 1) // 2)), "tile", "other").select("size", "x", "y")
    met = cut(pairs.mapInArrow(met_tiles(threshold), "a long, b long, links long, sure boolean"))
    full = lambda k: distinct.select(F.col("key").alias(k), F.col("v").alias(f"v_{k}"), F.col("copies").alias(f"n_{k}"))
    checked = met.where("not sure").select("a", "b").join(full("a"), "a").join(full("b"), "b").where(cosine(F.col("v_a"), F.col("v_b")) >= threshold)
    checked = cut(checked.select("a", "b", "n_a", "n_b"))
    sure = met.where("sure").select(F.col("a").alias("key"), "links")
    counts = sure.union(checked.select("a", "n_b")).union(checked.select("b", "n_a")).groupBy("key").agg(F.sum("links").alias("links"))
    linked = components(met.where("sure and a != b").select("a", "b").union(checked.select("a", "b")))
    labels = distinct.join(counts, "key", "left").join(linked.withColumnRenamed("node", "key"), "key", "left")
    labels = cut(labels.select("v", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "key").alias("root")))
    lowest = cut(labels.groupBy("root").agg(F.min("rep").alias("component_id")))
    labels = labels.join(lowest, "root").select("v", "n_links", "component_id")
    out = rows.where("usable").join(labels, "v").select("vec_id", "n_links", "component_id")
    out = out.union(rows.where("not usable").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def find(tops: list[int], k: int) -> int:
    while tops[k] != k:
        tops[k] = k = tops[tops[k]]
    return k


def forest(tops: list[int], a: np.ndarray, b: np.ndarray) -> None:
    """Join the parts of ``a`` and ``b`` pairwise; links inside a part known already are skipped at once."""
    while len(a):
        roots = np.array(tops)
        while True:
            higher = roots[roots]
            if (higher == roots).all():
                break
            roots = higher
        apart = roots[a] != roots[b]
        a, b = a[apart], b[apart]
        if not len(a):
            return
        _, first = np.unique(roots[a], return_index=True)
        for x, y in zip(a[first].tolist(), b[first].tolist(), strict=True):
            x, y = find(tops, x), find(tops, y)
            if x != y:
                tops[max(x, y)] = min(x, y)
