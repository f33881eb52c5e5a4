"""Substring dedup by compaction of a de Bruijn graph of token k-mers.

Within every window of words the k-mer with the least hash is its anchor, and the
windows that share an anchor form one edge: a stretch of up to ``2 * window - k``
words.  Edges whose anchor occurs in one document only are dropped.  An anchor always
found on the same stretch is a nonbranching path: all its windows occur in the same
documents, so it stays compact, with its first document.  Only where paths branch are
the distinct stretches read again at their source coordinates, and window hashes with
another base tell which windows they share.  Spark joins bring the first document of
each window to all its occurrences, and runs of covered words come together by document.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, cut

WINDOW, KMER = 50, 19
#: Fixed odd multipliers of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


@functools.lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = (np.full(n, x, np.uint64) for x in (base, pow(base, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any stretch of a word sequence in constant time each."""

    def __init__(self, hashes: np.ndarray, base: int):
        size = 1 << max(12, int(len(hashes)).bit_length())
        up, self.down = _powers(base, size)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64)])

    def of(self, start: np.ndarray, size) -> np.ndarray:
        return _mix((self.sums[start + size] - self.sums[start]) * self.down[start] + np.uint64(1) * np.asarray(size, np.uint64))


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def anchored_edges(hashes: np.ndarray, window: int, k: int):
    """(anchor, stretch, first window, number of windows) arrays: one entry for each edge of a document."""
    n = len(hashes) - window + 1
    if n < 1:
        return None
    kmers = Rolling(hashes, BASES[0]).of(np.arange(len(hashes) - k + 1), k)
    width = window - k + 1
    least, place, have = kmers, np.arange(len(kmers)), 1
    while have < width:  # leftmost least k-mer of each window, by doubling
        step = min(have, width - have)
        later = least[step:] < least[:-step]
        place = np.where(later, place[step:], place[:-step])
        least = np.where(later, least[step:], least[:-step])
        have += step
    first = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
    count = np.diff(np.concatenate([first, [n]]))
    at = place[first]
    stretch = Rolling(hashes, BASES[1]).of(first, count + (window - 1))
    stretch = _mix(stretch ^ ((at - first).astype(np.uint64) << np.uint64(32)) ^ count.astype(np.uint64))
    return kmers[at], stretch, first, count


def edges(docs: DataFrame, window: int = WINDOW, k: int = KMER) -> DataFrame:
    """(doc_id, text_key, anchor, stretch, lo, n) for each edge of each document."""

    def batches(frames):
        for frame in frames:
            for first in range(0, len(frame), 500):
                found = []
                for doc_id, key, text in frame.iloc[first : first + 500].itertuples(index=False):
                    e = anchored_edges(word_hashes(text), window, k)
                    if e is not None:
                        found.append((np.full(len(e[0]), doc_id), np.full(len(e[0]), key), *e))
                if found:
                    ids, keys, anchor, stretch, lo, n = map(np.concatenate, zip(*found, strict=True))
                    yield pd.DataFrame({"doc_id": ids.astype(np.int64), "text_key": keys, "anchor": anchor.view(np.int64), "stretch": stretch.view(np.int64), "lo": lo.astype(np.int32), "n": n.astype(np.int32)})

    rows = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInPandas(batches, "doc_id long, text_key long, anchor long, stretch long, lo int, n int")


def branch_windows(rows: DataFrame, window: int) -> DataFrame:
    """Hashes of the windows of the stretches listed in ``wanted`` beside each text."""

    def batches(frames):
        for frame in frames:
            for text, wanted in zip(frame["text"], frame["wanted"], strict=True):
                rolling = Rolling(word_hashes(text), BASES[1])
                anchor = np.array([w["anchor"] for w in wanted], np.int64)
                stretch = np.array([w["stretch"] for w in wanted], np.int64)
                doc = np.array([w["doc_id"] for w in wanted], np.int64)
                lo, n = (np.array([w[c] for w in wanted], np.int64) for c in ("lo", "n"))
                which = np.repeat(np.arange(len(lo)), n)
                off = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                h = rolling.of(lo[which] + off, window).view(np.int64)
                yield pd.DataFrame({"anchor": anchor[which], "stretch": stretch[which], "off": off.astype(np.int32), "hash": h, "first_doc": doc[which]})

    return rows.select("text", "wanted").mapInPandas(batches, "anchor long, stretch long, off int, hash long, first_doc long")


def covered_runs(docs: DataFrame, window: int = WINDOW, k: int = KMER, scratch=cut) -> DataFrame:
    """(doc_id, text_key, runs): runs (start, size) of words in windows that a smaller doc_id has too."""
    found = scratch(edges(docs, window, k))
    anchors = found.groupBy("anchor").agg(
        F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("_last"), (F.min("stretch") != F.max("stretch")).alias("branches")
    )
    anchors = cut(anchors.where("first_doc < _last").drop("_last"))
    repeated = scratch(found.join(anchors, "anchor"))
    straight = repeated.where("not branches and doc_id > first_doc").select("doc_id", "text_key", F.col("lo").alias("start"), (F.col("n") + (window - 1)).alias("size"))

    branching = repeated.where("branches").drop("first_doc")
    stretches = branching.groupBy("anchor", "stretch").agg(F.min(F.struct("doc_id", "text_key", "lo", "n")).alias("at"))
    wanted = stretches.select("at.*", "anchor", "stretch").groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("anchor", "stretch", "doc_id", "lo", "n")).alias("wanted"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    read = cut(wanted).join(texts, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"])
    windows = scratch(branch_windows(read, window))
    firsts = cut(windows.groupBy("anchor", "hash").agg(F.min("first_doc").alias("first_doc")))
    known = windows.drop("first_doc").join(firsts, ["anchor", "hash"])
    lists = cut(known.groupBy("anchor", "stretch").agg(F.collect_list(F.struct("off", "first_doc")).alias("firsts")))
    hit = F.transform(F.filter("firsts", lambda x: x["first_doc"] < F.col("doc_id")), lambda x: x["off"])
    crossed = branching.join(lists, ["anchor", "stretch"]).withColumn("hit", hit).where(F.size("hit") > 0)
    whole = F.size("hit") == F.col("n")
    runs = F.when(whole, F.array(F.struct(F.col("lo").alias("start"), (F.col("n") + (window - 1)).alias("size")))).otherwise(
        F.transform("hit", lambda o: F.struct((F.col("lo") + o).alias("start"), F.lit(window).alias("size")))
    )
    crossed = crossed.select("doc_id", "text_key", F.explode(runs).alias("run")).select("doc_id", "text_key", "run.*")
    return straight.union(crossed).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "size")).alias("runs"))


def _kept(text: str | None, runs) -> tuple[int, int, str, str]:
    """(words, words removed, kept words joined by one space, text without the removed words)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if runs is None or not len(runs):
        joined = b" ".join(words).decode("utf-8", "surrogatepass")
        return len(words), 0, joined, text
    step = np.zeros(len(words) + 1, np.int64)
    for run in runs:
        step[run["start"]] += 1
        step[run["start"] + run["size"]] -= 1
    gone = np.cumsum(step[:-1]) > 0
    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
    parts, at = [], 0
    for w, g in zip(words, gone.tolist(), strict=True):
        begin = data.index(w, at)
        if not g:
            parts.append((data[at:begin] if parts else b"") + w)
        at = begin + len(w)
    text = b"".join(parts).decode("utf-8", "surrogatepass")
    return len(words), int(gone.sum()), b" ".join(kept).decode("utf-8", "surrogatepass"), text


def remove_repeats(docs: DataFrame, window: int = WINDOW, k: int = KMER, texts: bool = True) -> DataFrame:
    """All columns of ``docs`` with repeated words gone from ``text``, plus (n_words, n_removed, kept_sha256).

    A word goes if it lies in a window of ``window`` words whose word sequence also
    starts in a document with a smaller id; windows are judged on the input.

    Defined results: a null text has no words and stays null; texts shorter than a
    window lose nothing; a document without an id neither loses words nor takes any from
    others; rows of equal id do not take words from each other; no rows give no rows.
    With ``texts`` false the other columns and the text are left out.
    """
    with Scratch(docs.sparkSession) as scratch:
        runs = cut(covered_runs(docs, window, k, scratch))
    own = ["n_words", "n_removed", "kept_sha256"]
    others = [c for c in docs.columns if c not in {*own, "__own_key", "__own_runs"}] if texts else ["doc_id"]
    rows = docs.select(*[f"`{c}`" for c in dict.fromkeys([*others, "doc_id", "text"])], F.xxhash64("text").alias("__own_key"))
    runs = runs.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text"), F.col("runs").alias("__own_runs"))
    joined = rows.join(runs, (F.col("doc_id") == F.col("_id")) & (F.col("__own_key") == F.col("_text")), "left").drop("_id", "_text", "__own_key")
    schema = T.StructType([rows.schema[c] for c in others])
    schema = schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")

    def batches(frames):
        for frame in frames:
            for first in range(0, len(frame), 1000):
                part = frame.slice(first, 1000)
                made = [_kept(t, r) for t, r in zip(part["text"].to_pylist(), part["__own_runs"].to_pylist(), strict=True)]
                kept = [pa.array([m[3] for m in made], pa.string()) if c == "text" else part[c] for c in others]
                sha = [hashlib.sha256(m[2].encode("utf-8", "surrogatepass")).hexdigest() for m in made]
                added = [pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.int64()), pa.array(sha, pa.string())]
                yield pa.RecordBatch.from_arrays([*kept, *added], [*others, *own])

    return joined.mapInArrow(batches, schema)
