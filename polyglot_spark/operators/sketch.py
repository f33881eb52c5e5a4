"""Bloom sketches of memory keys: which units a memory certainly lacks, known before any join.

A sketch covers the keys of one bucket, or of a part of it: a bucket of many keys has several
of bounded size, and those of later appends lie beside the earlier ones.  A key is the
SHA-256 of a unit, so that its own bytes are the hash functions.  A sketch travels with one
of its keys, which takes it to the partition where the units of its bucket go; it is sorted
before them, so that a task reads the sketches of its bucket first and then streams units.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = "unit_key binary, n long, bits binary"
#: Bits for each key, and probes of each; together about one key in a hundred that was never put in seems known.
BITS_A_KEY, PROBES = 10, 7
#: Most keys of one sketch, which then has a megabyte.
MOST_KEYS = 800_000


def _halves(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The first two 64-bit numbers of each key; keys are digests of 32 bytes."""
    raw = np.frombuffer(b"".join(keys.to_pylist()), "<u8").reshape(-1, 4)
    return raw[:, 0], raw[:, 1] | np.uint64(1)


def _probes(first: np.ndarray, step: np.ndarray, size: int) -> np.ndarray:
    """Bit numbers, one row for each probe; ``size`` is a power of two."""
    return np.stack([(first + np.uint64(k) * step) & np.uint64(size - 1) for k in range(PROBES)]).astype(np.int64)


def _sketch(first: np.ndarray, step: np.ndarray) -> bytes:
    size = max(64, 1 << int(np.ceil(np.log2(BITS_A_KEY * len(first)))))
    bits = np.zeros(size, np.bool_)
    bits[_probes(first, step, size).ravel()] = True
    return np.packbits(bits, bitorder="little").tobytes()


def built(keys: DataFrame, buckets: int, most_keys: int = MOST_KEYS) -> DataFrame:
    """(unit_key, n, bits) of the distinct or repeated ``unit_key`` of ``keys``: a sketch or more for each bucket that has any.

    Keys are told apart by their bucket inside a task too: Spark drops a repartition of a table that is dealt
    to the same buckets and may then read several of them, or a part of one, in a task.
    """

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[bytes, np.ndarray, np.ndarray]]] = {}
        counts: dict[int, int] = {}

        def flush(bucket: int) -> pa.RecordBatch:
            some, first, step = zip(*held.pop(bucket), strict=True)
            first, step = np.concatenate(first), np.concatenate(step)
            del counts[bucket]
            return pa.RecordBatch.from_arrays([pa.array(some[:1], pa.binary()), pa.array([len(first)], pa.int64()), pa.array([_sketch(first, step)], pa.binary())], ["unit_key", "n", "bits"])

        for batch in batches:
            for at in range(0, len(batch), 50_000):
                part = batch.slice(at, 50_000)
                column, bucket = part.column(0), part.column(1).to_numpy()
                first, step = _halves(column)
                for b in np.unique(bucket).tolist():
                    own = np.flatnonzero(bucket == b)
                    held.setdefault(b, []).append((column[int(own[0])].as_py(), first[own], step[own]))
                    counts[b] = counts.get(b, 0) + len(own)
                    if counts[b] + 50_000 > most_keys:
                        yield flush(b)
        for b in list(held):
            yield flush(b)

    rows = keys.select("unit_key", F.pmod(F.hash("unit_key"), F.lit(buckets)).alias("bucket")).where("unit_key is not null")
    return rows.repartition(buckets, "unit_key").mapInArrow(build, SCHEMA)


def tested(units: DataFrame, sketches: DataFrame, buckets: int) -> DataFrame:
    """``units`` with ``maybe_known``: false only where no sketch has the unit's ``unit_key``.

    Units and sketches are dealt to the buckets; within one, a task holds the sketches and streams the units.
    """
    columns = [f for f in units.schema if f.name != "maybe_known"]
    own = units.select(*[F.col(f"`{f.name}`") for f in columns])
    inner = T.StructType([T.StructField("unit_key", T.BinaryType()), T.StructField("bits", T.BinaryType()), T.StructField("row", T.StructType(columns))])
    out = T.StructType([T.StructField("row", T.StructType(columns)), T.StructField("maybe_known", T.BooleanType())])

    def test(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: list[np.ndarray] = []
        for batch in batches:
            bits = batch.column(1)
            lead = len(bits) - bits.null_count  # sketches are sorted first
            filters += [np.frombuffer(bits[i].as_py(), np.uint8) for i in range(lead)]
            rows = batch.slice(lead)
            if not len(rows):
                continue
            keys = rows.column(0)
            there = pc.fill_null(pc.equal(pc.binary_length(keys), 32), False).to_numpy(zero_copy_only=False)
            found = np.zeros(len(keys), bool)
            first, step = _halves(keys.filter(pa.array(there)) if not there.all() else keys)
            seen = np.zeros(len(first), bool)
            for f in filters:
                at = _probes(first, step, len(f) * 8)
                seen |= ((f[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)
            found[there] = seen
            yield pa.RecordBatch.from_arrays([rows.column(2), pa.array(found)], ["row", "maybe_known"])

    led = sketches.select("unit_key", "bits", F.lit(None).cast(T.StructType(columns)).alias("row"))
    both = led.unionByName(own.select("unit_key", F.lit(None).cast("binary").alias("bits"), F.struct("*").alias("row")))
    dealt = both.select(*inner.names).repartition(buckets, "unit_key").sortWithinPartitions(F.col("bits").isNull())
    return dealt.mapInArrow(test, out).select("row.*", "maybe_known")
