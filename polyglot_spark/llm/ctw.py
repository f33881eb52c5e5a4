"""LM scoring by context-tree weighting over binary-decomposed bytes.

The context of a byte is the ``depth`` bytes before it; each of its eight bits is coded
in the tree of contexts under the bits already seen.  A node holds the Krichevsky-
Trofimov estimate of its bit counts, and its weighted probability mixes that estimate
evenly with the product of its children's; the mixture over all depths gives the code
length of each byte.

Texts are coded as their lower-cased words with one blank between.  Corpus counts are
gathered per chunk of documents (about ``CHUNK`` bytes of text), so that each distinct
stretch of ``depth + 1`` bytes crosses the network once for each chunk, not once for each
occurrence.  Stretches travel as packed arrays, one for each chunk and bucket; a bucket
holds every stretch with the same last context bytes, and so whole subtrees.  The counts
of a bucket are added up as they stream by.  Deep nodes are worked out within the
buckets, the few levels above them by grouping; the code lengths of a bucket then meet
the chunks' stretches in a stream again and go back to the chunks.  No table of the
model reaches the driver or is broadcast.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut, remainder
from .tokens import distinct_words, slices

DEPTH, SHARED, CHUNK = 6, 3, 32 << 20
#: Fixed value: a byte that no UTF-8 text holds marks the end of a text and what lies before its start.
END = 0xFF
STRETCH, WORD_KEY, TEXT = 0, 1, 2
#: how the values of each kind are packed: code lengths, counts
VALUES = {STRETCH: "f4", WORD_KEY: "i8"}


def packed(x: np.ndarray) -> bytes:
    """An array as compressed byte planes; sorted integers as their steps."""
    if x.dtype == np.int64:
        x = np.diff(x, prepend=np.int64(0))
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1)
    x = np.ascontiguousarray(planes.T).view(kind).ravel()
    return np.cumsum(x) if kind == "i8" else x


def bucket_of(context, buckets: int):
    """Bucket of a shared context (numbers or a column)."""
    return context * 40503 % 2147483647 % buckets


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and their total counts."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(n, first)


def log_gamma(x: np.ndarray) -> np.ndarray:
    y = x + 8
    out = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    shift = np.ones_like(y)
    for i in range(8):
        shift *= x + i
    return out - np.log(shift)


def kt_log(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - math.log(math.pi) - log_gamma(a + b + 1)


def stretches(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For lower-cased texts: the code of the last ``depth + 1`` bytes at each byte and at the end, and their number in each text."""
    pad, end = bytes([END]) * depth, bytes([END])
    data = np.frombuffer(b"".join(x for t in texts for x in (pad, t, end)), np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    whole = sizes + depth
    at = np.arange(int(sizes.sum())) + np.repeat(np.cumsum(whole) - whole - (np.cumsum(sizes) - sizes), sizes)
    codes = np.zeros(len(at), np.int64)
    for k in range(depth + 1):
        codes = (codes << 8) | data[at + k]
    return codes, sizes


def word_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lower-cased texts, with one end token each, and their number in each text."""
    words, which, n = distinct_words(pa.array(texts, pa.binary()).view(pa.string()))
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words.view(pa.binary()).to_pylist()], np.uint64)
    keys = np.full(len(which) + len(n), xxhash.xxh3_64_intdigest(bytes([END])), np.uint64)
    keys[np.arange(len(which)) + np.repeat(np.arange(len(n)), n)] = hashes[which]
    return keys.view(np.int64), n + 1


def lowered(column) -> list[bytes]:
    """Texts as their lower-cased words with one blank between."""
    return [b" ".join((t or "").encode().lower().split()) for t in column.to_pylist()]


def packed_texts(doc_ids: pa.Array, trained: pa.Array, texts: list[bytes]) -> bytes:
    """Some documents of a chunk as a compressed Arrow stream."""
    batch, sink = pa.RecordBatch.from_arrays([doc_ids, trained, pa.array(texts, pa.large_binary())], ["doc_id", "trained", "text"]), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


class Sums:
    """Total counts of keys; what comes in is added up whenever there is more of it than held."""

    def __init__(self):
        self.keys, self.counts, self.new = [], [], 0

    def add(self, key: np.ndarray, n: np.ndarray) -> None:
        self.keys.append(key)
        self.counts.append(n)
        self.new += len(key)
        if self.new > max(1 << 20, len(self.keys[0])):
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) > 1:
            key, n = summed(self.keys, self.counts)
            self.keys, self.counts = [key], [n]
        self.new = 0
        return self.keys[0], self.counts[0]


def chunk_counts(depth: int, shared: int, buckets: int, chunk: int):
    """Task body: the texts of each chunk, runs of rows with about ``chunk`` bytes, and its distinct stretches and words with their counts in training rows, packed by bucket."""
    names = ["chunk", "bucket", "kind", "keys", "n"]

    def rows(number: int, sums: dict[int, Sums]):
        for kind, found in sums.items():
            key, n = found.total()
            bucket = bucket_of((key >> 8) & ((1 << (8 * shared)) - 1), buckets) if kind == STRETCH else key.view(np.uint64) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            bounds = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=bucket.dtype))
            some = np.flatnonzero(np.diff(bounds))
            own = [order[bounds[k] : bounds[k + 1]] for k in some]
            columns = [pa.array([packed(key[o]) for o in own], pa.binary()), pa.array([packed(n[o].astype(np.uint32)) for o in own], pa.binary())]
            heads = [pa.array(np.full(len(some), number)), pa.array(some, pa.int32()), pa.array(np.full(len(some), kind, np.int8))]
            yield pa.RecordBatch.from_arrays([*heads, *columns], names)

    def batches(frames):
        number, size, sums = TaskContext.get().partitionId() << 32, 0, None
        for frame in frames:
            trained = frame["trained"].to_numpy(zero_copy_only=False)
            for first, last in slices(frame["text"], 2 << 20):
                texts = lowered(frame["text"].slice(first, last - first))
                sums = sums or {STRETCH: Sums(), WORD_KEY: Sums()}
                for kind, (codes, sizes) in ((STRETCH, stretches(texts, depth)), (WORD_KEY, word_keys(texts))):
                    learnt = np.repeat(trained[first:last], sizes)
                    for weight, some in ((1, codes[learnt]), (0, codes[~learnt])):
                        if len(some):
                            key, n = np.unique(some, return_counts=True)
                            sums[kind].add(key, (n * weight).astype(np.uint32))
                own = [pa.array([packed_texts(*(frame[c].slice(first, last - first) for c in ("doc_id", "trained")), texts)], pa.binary()), pa.array([None], pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([0], pa.int32()), pa.array([TEXT], pa.int8()), *own], names)
                size += sum(map(len, texts)) + 64 * len(texts)
                if size >= chunk:
                    yield from rows(number, sums)
                    number, size, sums = number + 1, 0, None
        if sums:
            yield from rows(number, sums)

    return batches


def merge_counts(frames):
    """Task body: one row of each bucket from all its rows, which come one after another."""

    def row(at, sums):
        key, n = sums.total()
        columns = [pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int8()), pa.array([packed(key)], pa.binary()), pa.array([packed(n)], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "kind", "keys", "n"])

    now, sums = None, None
    for frame in frames:
        for k, at in enumerate(zip(frame["bucket"].to_pylist(), frame["kind"].to_pylist(), strict=True)):
            if at != now:
                if sums:
                    yield row(now, sums)
                now, sums = at, Sums()
            sums.add(unpacked(frame["keys"][k].as_py(), "i8"), unpacked(frame["n"][k].as_py(), "u4").astype(np.uint64))
    if sums:
        yield row(now, sums)


def bit_nodes(key: np.ndarray, n: np.ndarray, d: int):
    """Nodes of depth ``d`` under the given stretches: sorted node keys (context, bits seen) and their counts of zeros and ones."""
    byte, context = key & 255, (key >> 8) & ((1 << (8 * d)) - 1)
    node = np.concatenate([(context << 8) | (1 << b) | (byte >> (8 - b)) for b in range(8)])
    ones = np.concatenate([n * ((byte >> (7 - b)) & 1) for b in range(8)])
    order = np.argsort(node, kind="stable")
    node, ones, total = node[order], ones[order], np.tile(n, 8)[order]
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    ones, total = np.add.reduceat(ones, first), np.add.reduceat(total, first)
    return node[first], (total - ones).astype(float), ones.astype(float)


def parent(node: np.ndarray, d: int) -> np.ndarray:
    """The node one level up from nodes of depth ``d``: the oldest context byte is forgotten."""
    return (((node >> 8) & ((1 << (8 * (d - 1))) - 1)) << 8) | (node & 255)


def weighted(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log weighted probability of nodes and the share of their own estimate in it."""
    return np.logaddexp(own, below) - math.log(2), 1 / (1 + np.exp(np.clip(below - own, -700, 700)))


def subtree(key: np.ndarray, n: np.ndarray, depth: int, top: int) -> list[list[np.ndarray]]:
    """For depths ``depth`` down to ``top``: node keys, zeros, ones, share of the own estimate, log weighted probability."""
    levels, deeper = [], None
    for d in range(depth, top - 1, -1):
        node, a, b = bit_nodes(key, n, d)
        own = kt_log(a, b)
        if deeper is None:
            total, share = own, np.ones(len(node))
        else:
            below = np.bincount(np.searchsorted(node, parent(deeper[0], d + 1)), deeper[4], len(node))
            total, share = weighted(own, below)
        deeper = [node, a, b, share, total]
        levels.append(deeper)
    return levels[::-1]


def shared_nodes(depth: int, top: int):
    """Task body: the nodes of depth ``top`` of each bucket."""

    def batches(tables):
        for table in tables:
            for keys, n in zip(table["keys"].to_pylist(), table["n"].to_pylist(), strict=True):
                node, a, b, _, total = subtree(unpacked(keys, "i8"), unpacked(n, "u8").astype(np.int64), depth, top)[0]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node, a, b, total)], ["node", "zeros", "ones", "total"])

    return batches


def estimate(a: np.ndarray, b: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Probability of a one by a node's own counts; a node never seen in training keeps its parent's."""
    return np.where(a + b > 0, (b + 0.5) / (a + b + 1), before)


def code_lengths(depth: int, top: int):
    """Task body: log10 probability of the last byte of each stretch of a bucket, given the mixture above depth ``top``."""

    def work(counts: pa.Table, above: pa.Table) -> pa.Table:
        if not counts.num_rows:
            return pa.table({"bucket": pa.array([], pa.int32()), "model": pa.array([], pa.binary()), "values": pa.array([], pa.binary())})
        key, n = unpacked(counts["keys"][0].as_py(), "i8"), unpacked(counts["n"][0].as_py(), "u8").astype(np.int64)
        node, mixed, rest, last = (above[c].to_numpy() for c in ("node", "mixed", "rest", "last"))
        order = np.argsort(node, kind="stable")
        levels = subtree(key, n, depth, top)
        at = order[np.searchsorted(node[order], levels[0][0])]
        mixed, rest, last = mixed[at], rest[at], last[at]
        for d, (own, a, b, share, _) in enumerate(levels, top):
            if d > top:
                up = np.searchsorted(levels[d - top - 1][0], parent(own, d))
                mixed, rest, last = mixed[up], rest[up], last[up]
            one = estimate(a, b, last)
            share = np.where(a + b > 0, share, 1.0)
            mixed, rest, last = mixed + rest * share * one, rest * (1 - share), one
        byte, context, out = key & 255, (key >> 8) & ((1 << (8 * depth)) - 1), np.zeros(len(key))
        for b in range(8):
            p = mixed[np.searchsorted(levels[-1][0], (context << 8) | (1 << b) | (byte >> (8 - b)))]
            out += np.log10(np.where((byte >> (7 - b)) & 1, p, 1 - p))
        row = [counts["bucket"].slice(0, 1), counts["keys"].slice(0, 1), pa.array([packed(out.astype(np.float32))], pa.binary())]
        return pa.Table.from_arrays(row, ["bucket", "model", "values"])

    return work


def tree_code_lengths(counts: DataFrame, depth: int, top: int, buckets: int, scratch: Scratch) -> DataFrame:
    """(bucket, model, values): log10 probability of each stretch's last byte under the whole tree, packed."""
    nodes = scratch(counts.mapInArrow(shared_nodes(depth, top), "node long, zeros double, ones double, total double"))

    own = F.pandas_udf(lambda a, b: a * 0 + kt_log(a.to_numpy(), b.to_numpy()), "double")
    up = lambda d: F.shiftleft(F.shiftright("node", 8).bitwiseAND(F.lit((1 << (8 * d)) - 1)), 8) + F.col("node") % 256
    levels = {top: nodes}
    for d in range(top - 1, -1, -1):
        sums = levels[d + 1].groupBy(up(d).alias("node")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("total").alias("below"))
        sums = sums.withColumn("own", own("zeros", "ones"))
        share = 1 / (1 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("below") - F.col("own")))))
        high = F.greatest("own", "below")
        total = high + F.log(F.exp(F.col("own") - high) + F.exp(F.col("below") - high)) - math.log(2)
        levels[d] = scratch(sums.select("node", "zeros", "ones", total.alias("total"), share.alias("share")))
    mixed = None
    for d in range(top):
        level = levels[d]
        if mixed is None:
            level = level.withColumns({"mixed": F.lit(0.0), "rest": F.lit(1.0), "last": F.lit(0.5)})
        else:
            level = level.withColumn("up", up(d - 1)).join(mixed.withColumnRenamed("node", "up"), "up")
        seen = F.col("zeros") + F.col("ones") > 0
        one = F.when(seen, (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1)).otherwise(F.col("last"))
        share = F.when(seen, F.col("share")).otherwise(1.0)
        mixed = level.select("node", (F.col("mixed") + F.col("rest") * share * one).alias("mixed"), (F.col("rest") * (1 - share)).alias("rest"), one.alias("last"))
    above = nodes.select("node", up(top - 1).alias("up")).join(mixed.withColumnRenamed("node", "up"), "up")
    bucket = bucket_of(F.shiftright("node", 8), buckets).cast("int")
    above = above.select(bucket.alias("bucket"), "node", "mixed", "rest", "last")
    both = counts.select("bucket", "keys", "n").groupBy("bucket").cogroup(above.groupBy("bucket"))
    return scratch(both.applyInArrow(code_lengths(depth, top), "bucket int, model binary, values binary"))


def looked_up(frames):
    """Task body: the values of the chunks' keys of each bucket; the model's row comes before those of the chunks."""
    schema = {"chunk": pa.int64(), "kind": pa.int8(), "keys": pa.binary(), "values": pa.binary()}
    key = value = None
    for frame in frames:
        found = []
        for row in range(len(frame)):
            keys, values, kind = frame["keys"][row].as_py(), frame["values"][row].as_py(), frame["kind"][row].as_py()
            if values is not None:
                key, value = unpacked(keys, "i8"), unpacked(values, VALUES[kind])
            else:
                found.append((frame["chunk"][row].as_py(), kind, keys, packed(value[np.searchsorted(key, unpacked(keys, "i8"))])))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), schema.values(), strict=True)], list(schema))


def word_totals(tables):
    """Task body: training tokens and distinct training tokens of some buckets."""
    for table in tables:
        n = [unpacked(x, "u8") for x in table["n"].to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([int(x.sum()) for x in n], pa.int64()), pa.array([int((x > 0).sum()) for x in n], pa.int64())], ["tokens", "types"])


def word_values(tables):
    """Task body: the counts of words as their values."""
    for table in tables:
        values = [packed(unpacked(x, "u8").astype(np.int64)) for x in table["n"].to_pylist()]
        yield pa.RecordBatch.from_arrays([table["bucket"], table["keys"], pa.array(values, pa.binary())], ["bucket", "model", "values"])


def values_at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of wanted keys; they are sorted first, so that each distinct one is looked up once and in order."""
    order = np.argsort(wanted)
    ranked = wanted[order]
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    found = values[np.searchsorted(keys, ranked[fresh])]
    out = np.empty(len(wanted))
    out[order] = found[np.cumsum(fresh) - 1]
    return out


def chunk_scores(depth: int, n_train: int, n_types: int):
    """Task body: the scores of a chunk's documents from the values of its stretches and words."""

    def score(docs: pa.Table, values: pa.Table) -> pa.Table:
        tables, kinds = {}, values["kind"].to_pylist()
        for kind in (STRETCH, WORD_KEY):
            rows = [k for k, x in enumerate(kinds) if x == kind]
            key = np.concatenate([unpacked(values["keys"][k].as_py(), "i8") for k in rows])
            value = np.concatenate([unpacked(values["values"][k].as_py(), VALUES[kind]) for k in rows])
            order = np.argsort(key, kind="stable")
            tables[kind] = key[order], value[order].astype(float)
        out = {"n_tokens": [], "n_known": [], "base_score": [], "score": []}
        parts = []
        for data in docs["keys"]:
            with pa.ipc.open_stream(data.as_buffer()) as stream:
                part = stream.read_all()
            parts.append(part.select(["doc_id", "trained"]))
            texts = part["text"].to_pylist()
            codes, sizes = stretches(texts, depth)
            lengths = values_at(*tables[STRETCH], codes)
            out["score"].append(np.add.reduceat(lengths, np.cumsum(sizes) - sizes))
            codes, sizes = word_keys(texts)
            seen = values_at(*tables[WORD_KEY], codes)
            first_of = np.cumsum(sizes) - sizes
            out["n_tokens"].append(sizes)
            out["n_known"].append(np.add.reduceat((seen > 0).astype(np.int64), first_of))
            out["base_score"].append(np.add.reduceat(np.log10((seen + 0.5) / (n_train + 0.5 * (n_types + 1))), first_of))
        docs = pa.concat_tables(parts)
        added = {c: np.concatenate(x) if x else np.zeros(0) for c, x in out.items()}
        return pa.table({"doc_id": docs["doc_id"], "held_out": pa.compute.invert(docs["trained"]), **added})

    return score


def score(docs: DataFrame, depth: int = DEPTH, shared: int = SHARED, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``score`` is the log10 probability of the lower-cased text (white space as one blank) and its end under the tree
    learnt from the rows that are not held out; ``base_score`` is that of its words and
    their end by add-half unigram counts.

    Defined results: a null or empty text is its end alone; without training rows every
    bit has probability 1/2 and counts are 0; repeated rows are counted and scored each;
    no rows give no rows; further columns are ignored.  Words are told apart by 64-bit hashes.

    More text has more buckets (by a power below 1, as distinct stretches do not grow in
    proportion) and, beyond 16 GB, a longer shared context, so that a bucket stays small.
    """
    with Scratch(docs.sparkSession) as scratch:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (remainder(F.col("doc_id")) != 1).alias("trained"))
        bytes_ = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 1
        buckets = max(64, math.ceil(2 * (bytes_ / (4 << 20)) ** 0.75))
        shared = min(depth, shared + max(0, math.ceil(math.log2(bytes_ / (16 << 30)) / 8)))
        found = scratch(rows.mapInArrow(chunk_counts(depth, shared, buckets, chunk), "chunk long, bucket int, kind byte, keys binary, n binary"))
        texts, found = found.where(F.col("kind") == TEXT).select("chunk", "keys"), found.where(F.col("kind") != TEXT)
        keys = ["bucket", "kind"]
        dealt = found.drop("chunk").repartition(*keys).sortWithinPartitions(*keys)
        counts = scratch(dealt.mapInArrow(merge_counts, "bucket int, kind byte, keys binary, n binary"))
        of_words = counts.where(F.col("kind") == WORD_KEY)
        totals = of_words.mapInArrow(word_totals, "tokens long, types long")
        n_train, n_types = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
        lengths = tree_code_lengths(counts.where(F.col("kind") == STRETCH), depth, shared, buckets, scratch)
        models = lengths.withColumn("kind", F.lit(STRETCH).cast("byte")).unionByName(
            of_words.mapInArrow(word_values, "bucket int, model binary, values binary").withColumn("kind", F.lit(WORD_KEY).cast("byte"))
        )
        models = models.select(F.lit(None).cast("long").alias("chunk"), *keys, F.col("model").alias("keys"), "values")
        met = models.union(found.select("chunk", *keys, "keys", F.lit(None).cast("binary")))
        met = met.repartition(*keys).sortWithinPartitions(*keys, F.col("chunk").asc_nulls_first())
        back = met.mapInArrow(looked_up, "chunk long, kind byte, keys binary, values binary")
        schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
        scored = cut(texts.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(chunk_scores(depth, n_train, n_types), schema))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")
