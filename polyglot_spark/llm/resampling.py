"""Target-distribution importance resampling over hashed word n-grams.

Every text is a bag of its runs of one to three words, each hashed by CRC-32 into one of
``buckets``.  The bags of all documents and of all target texts give each bucket an
integer gain, a document's weight is the sum over an array of gains, and a Gumbel draw
fixed by its id is added to it.  The best scores are found without sorting documents: an
exact histogram of the integer scores, summed up from the top, says how many documents
stand above each score, so that only documents from the cutoff score on are ranked.

The hash of a run is put together from those of its words: a CRC is linear, so that
appending n bytes is four table lookups.  Hashing is thus a few array operations for a
whole text and no string of a run is ever made.

Defined results: null, empty and wordless texts have no features and weight 0; texts of
any length are one bag; rows with a null id draw as if the id were the empty text and
rank last among equal scores; repeated rows are documents of their own, each with its own rank;
an empty table draws nothing, without targets their counts are 0; further columns take
no part unless named in ``carry``, whatever they are called.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut

#: Words of up to so many bytes are hashed side by side, longer ones one by one.
SHORT = 64
#: Bytes of text that are hashed at a time, which bounds a worker's arrays; a longer text is hashed alone.
PIECE = 1 << 20

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
IN_WORD = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])


def _byte_table() -> np.ndarray:
    """What the low byte of a CRC-32 state turns into when a byte is appended."""
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = (crc >> np.uint32(1)) ^ np.where(crc & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return crc


BYTE = _byte_table()


def _zeros_tables(most: int) -> np.ndarray:
    """[n, k, b]: what byte k of a state, if it is b and the others are 0, turns into behind n zero bytes."""
    tables = np.zeros((most + 1, 4, 256), np.uint32)
    for k in range(4):
        tables[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(most):
        tables[n + 1] = (tables[n] >> np.uint32(8)) ^ BYTE[tables[n] & np.uint32(255)]
    return tables


BEHIND = _zeros_tables(SHORT + 1)


def behind(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The share of each checksum in that of a text continued by ``size`` bytes."""
    out, near = np.empty_like(crc), np.minimum(size, SHORT + 1)
    flat, at = BEHIND.ravel(), near * 1024
    out = flat[at + (crc & 255)] ^ flat[at + 256 + ((crc >> 8) & 255)] ^ flat[at + 512 + ((crc >> 16) & 255)] ^ flat[at + 768 + (crc >> 24)]
    for i in np.flatnonzero(size > SHORT + 1):  # few: words over 64 bytes
        value, left = out[i : i + 1], int(size[i]) - SHORT - 1
        while left:
            step = min(left, SHORT + 1)
            value, left = behind(value, np.array([step])), left - step
        out[i] = value[0]
    return out


def word_checksums(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word of lower-cased UTF-8: its first byte, its length and its CRC-32."""
    raw = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], IN_WORD[raw], [False]]).astype(np.int8)))
    start, size = edge[::2], edge[1::2] - edge[::2]
    order = np.argsort(-size, kind="stable")  # longest first: those still going on are always a prefix
    first, length = start[order], size[order]
    state = np.full(len(start), 0xFFFFFFFF, np.uint32)
    long = int(np.searchsorted(-length, -SHORT, side="left"))  # words of more than SHORT bytes
    for k in range(int(length[long]) if long < len(length) else 0):
        going = slice(long, int(np.searchsorted(-length, -k, side="left")))
        old = state[going]
        state[going] = (old >> np.uint32(8)) ^ BYTE[(old ^ raw[first[going] + k]) & np.uint32(255)]
    state ^= np.uint32(0xFFFFFFFF)
    for i in range(long):
        state[i] = zlib.crc32(data[first[i] : first[i] + length[i]])
    crc = np.empty_like(state)
    crc[order] = state
    return start, size, crc


def feature_hashes(texts: list[bytes | None], longest: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, checksum) of every run of 1 to ``longest`` words, and each text's number of words."""
    joined = b"\x00".join((t or b"").translate(LOWER) for t in texts)
    bounds = np.cumsum([len(t or b"") + 1 for t in texts])
    start, size, crc = word_checksums(joined)
    owner = np.searchsorted(bounds, start, side="right")
    blank = np.full(len(crc), zlib.crc32(b" "), np.uint32)
    led = behind(blank, size) ^ crc  # of a word with the blank before it
    owners, hashes, run = [owner], [crc], crc
    for n in range(1, longest):
        run = behind(run[:-1], size[n:] + 1) ^ led[n:]
        within = owner[n:] == owner[: len(owner) - n]
        owners.append(owner[n:][within])
        hashes.append(run[within])
    return np.concatenate(owners), np.concatenate(hashes), np.bincount(owner, minlength=len(texts))


def _pieces(column: pa.Array) -> Iterator[list[bytes | None]]:
    """The texts of a batch, some megabyte at a time."""
    held, size = [], 0
    for value in column.cast(pa.large_binary()):
        text = value.as_py()
        held.append(text)
        size += len(text or b"")
        if size >= PIECE:
            yield held
            held, size = [], 0
    if held:
        yield held


def bucket_counts(texts: DataFrame, column: str = "text", buckets: int = 10_000, longest: int = 3) -> DataFrame:
    """(bucket, n): features of all texts in each bucket that has any, added up in tasks before they are shuffled."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for held in _pieces(batch.column(0)):
                total += np.bincount(feature_hashes(held, longest)[1] % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["bucket", "n"])

    return texts.select(F.col(column)).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = 10_000) -> list[int]:
    """For each bucket 1000 times the logarithm of its smoothed share in the target over that in the source, rounded down.

    The list has one number for each bucket, whatever the size of the tables.
    """
    every = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    both = cut(both)
    all_s, all_t = map(float, both.agg(F.sum("s"), F.sum("t")).first())
    double = lambda c: F.col(c).cast("double")
    ratio = (double("t") + 1) * (F.lit(all_s) + buckets) / ((double("s") + 1) * (F.lit(all_t) + buckets))
    return [r.gain for r in both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).orderBy("bucket").collect()]


def weighed(docs: DataFrame, gain: list[int], column: str = "text", longest: int = 3, carry: list[str] = ()) -> DataFrame:
    """(doc_id, [own,] n_words, n_features, weight) of every row; ``own`` is a struct of the carried columns, if there are any."""
    table, buckets = np.array(gain, np.int64), len(gain)
    own = [F.struct(*[f"`{c}`" for c in carry]).alias("own")] if carry else []
    apart = docs.select("doc_id", *own, F.col(f"`{column}`").alias("_text"))
    schema = T.StructType(apart.schema.fields[:-1]).add("n_words", "long").add("n_features", "long").add("weight", "long")

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for held in _pieces(batch.column(batch.num_columns - 1)):
                owner, hashes, n_words = feature_hashes(held, longest)
                n_features = np.bincount(owner, minlength=len(held))
                ends = np.argsort(owner, kind="stable")
                sums = np.concatenate([[0], np.cumsum(table[hashes[ends] % np.uint32(buckets)])])
                stop = np.cumsum(n_features)
                weight = sums[stop] - sums[stop - n_features]
                own = [batch.column(i).slice(at, len(held)) for i in range(batch.num_columns - 1)]
                at += len(held)
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(x.astype(np.int64)) for x in (n_words, n_features, weight)]], schema.names)

    return apart.mapInArrow(weigh, schema)


def gumbel(doc_id, seed: int = 42) -> F.Column:
    """1000 times the Gumbel variate of an id, rounded down: fixed by its SHA-256, so that reruns agree."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def above_each(scores: DataFrame) -> DataFrame:
    """(score, above): of an exact histogram (score, n), how many rows have a higher score.

    The histogram is range-partitioned from the top and every part summed up; the sums of
    the parts (a row each) then lift the sums inside them.
    """
    parts = cut(scores.repartitionByRange(F.desc("score")).withColumn("_part", F.spark_partition_id()))
    sums = parts.groupBy("_part").agg(F.sum("n").alias("_n"))
    base = sums.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))
    inside = F.sum("n").over(Window.partitionBy("_part").orderBy(F.desc("score"))) - F.col("n")
    return parts.withColumn("_inside", inside).join(base, "_part").select("score", (F.col("_inside") + F.col("_base")).alias("above"))


def draw(weighted: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """All rows of ``weighed`` with (score, rank): the best ``percent`` of the rows with enough words have ranks from 1, others null.

    Rows that agree in id, features and weight stand for each other; they are counted in
    the slices they were read in, so that no task holds all copies of one document.
    """
    scored = cut(weighted.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumn("_slice", F.spark_partition_id()))
    enough = scored.where(F.col("n_words") >= least_words)
    histogram = enough.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    offsets = cut(above_each(histogram))
    size = enough.count() * percent // 100
    cutoff = offsets.where(F.col("above") < size).agg(F.min("score")).first()[0]
    if cutoff is None:
        return scored.drop("_slice").withColumn("rank", F.lit(None).cast("long"))
    survives = F.coalesce((F.col("n_words") >= least_words) & (F.col("score") >= cutoff), F.lit(False))
    alike = ["score", "doc_id", "n_features", "weight", "_slice"]
    survivors = scored.where(survives)
    counts = survivors.groupBy(*alike).agg(F.count(F.lit(1)).alias("_n")).join(offsets.where(F.col("score") >= cutoff), "score")
    by_id = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features", "weight", "_slice")
    counts = counts.withColumn("_before", F.sum("_n").over(by_id.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n") + F.col("above"))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"c.{c}")) for c in alike]
    ranked = survivors.alias("s").join(counts.alias("c"), same).select("s.*", "c._before")
    ranked = ranked.withColumn("rank", F.col("_before") + F.row_number().over(Window.partitionBy(*alike).orderBy("_before")))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= size, F.col("rank"))).drop("_before", "_slice")
    return scored.where(~survives).drop("_slice").withColumn("rank", F.lit(None).cast("long")).unionByName(ranked)


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 5, least_words: int = 20, buckets: int = 10_000, longest: int = 3, seed: int = 42, carry: list[str] = ()) -> DataFrame:
    """(doc_id, [own,] n_words, n_features, weight, score, rank) of every row of ``docs``, drawn towards the texts of ``target``; ``own`` as for ``weighed``."""
    gain = gains(bucket_counts(docs, "text", buckets, longest), bucket_counts(target, "text", buckets, longest), buckets)
    return draw(weighed(docs, gain, "text", longest, carry), percent, least_words, seed)


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents, with all their columns."""
    return resample(docs, target, carry=docs.columns, **options).where("rank is not null").select("own.*")
