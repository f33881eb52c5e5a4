"""SimHash near-dedup with a Gray-order hierarchical index.

Distinct fingerprints are looked up through nodes, each the bit pattern its members
share under a mask.  The upper nodes fix two of ``distance + 2`` blocks, so that two
fingerprints within ``distance`` meet in at least one.  A node with many members is
factored again: each child fixes one of ``distance + 1`` parts of the free bits,
which keeps every pair within reach, until all nodes are small; the number of free
bits bounds the depth and the final size.  Inside a node the fingerprints are sorted
by Gray rank; runs of neighbours share most bits, and pairs of runs whose shared bits
already differ too often are pruned whole before any members are compared.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, cut

RUN, LEAF = 16, 1024


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles, as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(whole, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(whole[a:b], 42) for a, b in zip(starts[:last].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, last)
    ones = np.zeros(64, np.int64)
    for at in range(0, last, 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > last).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """All columns of ``docs`` but the text, and ``fp``: the fingerprint as a signed long."""
    others = [c for c in docs.columns if c not in ("text", "fp")]
    schema = T.StructType([docs.schema[c] for c in others]).add("fp", "long")

    def batches(frames):
        for frame in frames:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in frame["text"]), np.uint64, len(frame)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[frame[c] for c in others], pa.array(fp)], schema.names)

    return docs.mapInArrow(batches, schema)


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def bit_blocks(mask: int, n: int) -> list[int]:
    """Deal the set bits of ``mask`` into ``n`` blocks of neighbours."""
    bits = [i for i in range(64) if mask >> i & 1]
    return [sum(1 << b for b in bits[len(bits) * i // n : len(bits) * (i + 1) // n]) for i in range(n)]


def gray_rank(column) -> F.Column:
    """Place of a bit pattern in the binary reflected Gray sequence."""
    for shift in (1, 2, 4, 8, 16, 32):
        column = column.bitwiseXOR(F.shiftrightunsigned(column, shift))
    return column


def linked_in_node(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within ``distance`` among the Gray-sorted members of one node."""
    runs = -(-len(fp) // RUN)
    padded = np.concatenate([fp, np.repeat(fp[-1:], runs * RUN - len(fp))]).reshape(runs, RUN)
    differ = np.bitwise_or.reduce(padded ^ padded[:, :1], axis=1)
    i, j = np.triu_indices(runs)
    apart = np.bitwise_count((padded[i, 0] ^ padded[j, 0]) & ~(differ[i] | differ[j]))
    i, j = i[apart <= distance], j[apart <= distance]
    r, a, b = np.nonzero(np.bitwise_count(padded[i][:, :, None] ^ padded[j][:, None, :]) <= distance)
    a, b = i[r] * RUN + a, j[r] * RUN + b
    real = (a < b) & (b < len(fp))
    return a[real], b[real]


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> list[int]:
    """Numbers of the links that join parts not joined before."""
    top, kept = list(range(n)), []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while top[x] != x:
            top[x] = x = top[top[x]]
        while top[y] != y:
            top[y] = y = top[top[y]]
        if x != y:
            top[y] = x
            kept.append(k)
    return kept


def node_links(distance: int):
    """Task body: links among the members of each node of a partition sorted by node and Gray rank."""

    def links(mask, bits, fp):
        fp = fp.view(np.uint64)
        change = np.flatnonzero((mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1])) + 1
        starts, ends = np.concatenate([[0], change]), np.concatenate([change, [len(fp)]])
        size = np.repeat(ends - starts, ends - starts)
        node = np.repeat(np.arange(len(starts)), ends - starts)
        for k in range(1, RUN):
            near = np.flatnonzero((node[k:] == node[:-k]) & (size[k:] <= RUN) & (np.bitwise_count(fp[k:] ^ fp[:-k]) <= distance))
            if len(near):
                yield fp[near], fp[near + k]
        for s in np.flatnonzero(ends - starts > RUN):
            own = fp[starts[s] : ends[s]]
            a, b = linked_in_node(own, distance)
            kept = spanning(a, b, len(own))
            yield own[a[kept]], own[b[kept]]

    def batches(frames):
        held = None
        for frame in frames:
            now = [frame[c].to_numpy(np.int64) for c in ("mask", "bits", "fp")]
            now = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            mask, bits, _ = now
            whole = np.flatnonzero((mask != mask[-1]) | (bits != bits[-1]))
            stop = whole[-1] + 1 if len(whole) else 0  # the last node may go on in the next batch
            for a, b in links(*[x[:stop] for x in now]) if stop else ():
                yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})
            held = [x[stop:] for x in now]
        for a, b in links(*held) if held is not None and len(held[0]) else ():
            yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return batches


def near_links(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` within ``distance`` bits of each other."""
    masks = [x | y for x, y in combinations(bit_blocks((1 << 64) - 1, distance + 2), 2)]
    rows = distinct.select("fp", F.explode(F.array(*[F.lit(signed(m)) for m in masks])).alias("mask"))
    links, spark = None, distinct.sparkSession
    while masks:
        rows = rows.withColumn("bits", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = cut(rows.groupBy("mask", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        joined = rows.join(sizes, ["mask", "bits"])
        leaves = joined.where(F.col("n") <= LEAF).select("mask", "bits", "fp")
        free = F.col("fp").bitwiseAND(F.bitwise_not("mask"))
        # dealt by a value of its own: Spark drops a repartition by the keys of the join before it, and may then split a large node as a skewed join
        ranked = leaves.repartition(F.xxhash64("mask", "bits")).sortWithinPartitions("mask", "bits", gray_rank(free))
        found = ranked.mapInPandas(node_links(distance), "a long, b long")
        links = found if links is None else links.union(found)
        if sizes.where(F.col("n") > LEAF).isEmpty():
            break
        parts = {m: bit_blocks(~m & (1 << 64) - 1, distance + 1) for m in masks}
        children = spark.createDataFrame([(signed(m), [signed(m | p) for p in ps]) for m, ps in parts.items()], "mask long, children array<long>")
        masks = sorted({m | p for m, ps in parts.items() for p in ps})
        rows = cut(joined.where(F.col("n") > LEAF).join(F.broadcast(children), "mask").select("fp", F.explode("children").alias("mask")))
    return links


def near_groups(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of every row, with any further columns: groups of documents linked by near fingerprints.

    Defined results: a null or empty text has fingerprint zero and is linked like any
    other; a text of fewer words than a shingle is one shingle; repeated rows and equal
    texts share a fingerprint; ``component_id`` is the smallest id reachable (null ids
    count only where a group has no other); no rows give no rows.
    """
    prints = cut(fingerprints(docs, shingle))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    linked = components(cut(near_links(distinct.select("fp"), distance)))
    rooted = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = cut(rooted.join(lowest, "root").select("fp", "component_id"))
    return prints.join(labels, "fp")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """One document of each group: the row of the smallest id, of several texts or rows with that id one."""
    own = {"__own_id": F.coalesce("doc_id", F.lit(0)), "__own_none": F.col("doc_id").isNull(), "__own_key": F.xxhash64("text")}
    groups = near_groups(docs.select("doc_id", "text", *[c.alias(n) for n, c in own.items()]), **options)
    first = groups.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("_alone")).agg(F.min(F.struct("__own_none", "__own_id", "__own_key")).alias("at"))
    kept = docs.withColumns(own).join(first.select("at.*"), list(own))
    return kept.dropDuplicates(list(own)).select(*[f"`{c}`" for c in docs.columns])
