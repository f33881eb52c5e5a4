"""Media columns: chroma audio fingerprints and the alignment of recordings.

Short spectra are folded into twelve pitch classes; filters over the integral image of
those frames are quantised to two bits each, and sixteen of them make a packed 32-bit
code for each frame.  Recordings with equal codes are one class.  A landmark, a code and
the upper 20 bits of the first one that shares no frame with it, votes for the offset of two recordings that have it, and bit
errors in a window of codes around it confirm the vote.  The codes around a landmark are its context: equal
contexts are linked to one of them, and only distinct contexts of a landmark are
compared, in blocks where there are many.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, components, cut
from .embeddings import find, forest

RATE, WIDTH = 2000, 8
#: codes in a window of the bit-error test, its largest share of wrong bits, and distinct contexts in a block
SPAN, ERRORS, BLOCK = 16, 0.15, 4096
#: codes kept before a landmark and from it on: those of all windows of ``SPAN`` codes that hold both of its codes
BEFORE, AFTER = SPAN - 1 - WIDTH, SPAN


def frame_size(rate: int) -> int:
    """Samples in a frame, a power of two of about a quarter of a second; frames begin half a frame apart."""
    return 1 << round(np.log2(rate * 0.256))


HOP = frame_size(RATE) // 2


def filter_shapes() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, classes, frames) of the sixteen filters, laid out by rule."""
    shapes = []
    for i in range(16):
        tall, wide = (12, 6, 4, 3)[i % 4], (2, 4, 6, 8)[i // 4]
        shapes.append((i % 5, i * 5 % (13 - tall), tall, wide))
    return shapes


def pitch_classes(samples: np.ndarray, rate: int = RATE, block: int = 2048) -> np.ndarray:
    """Frames of twelve pitch-class energies, each of length one (zero for silence), worked out some at a time."""
    frame = frame_size(rate)
    hop = frame // 2
    n = (len(samples) - frame) // hop + 1
    if n < 1:
        return np.zeros((0, 12))
    hertz = np.fft.rfftfreq(frame, 1 / rate)
    heard = (hertz >= 100) & (hertz <= min(rate / 2, 3500))
    fold = np.zeros((len(hertz), 12))
    fold[heard, np.rint(12 * np.log2(hertz[heard] / 440)).astype(int) % 12] = 1
    window, out = np.hanning(frame).astype(np.float32), []
    for at in range(0, n, block):
        part = samples[at * hop : (min(n, at + block) - 1) * hop + frame]
        frames = np.lib.stride_tricks.sliding_window_view(part, frame)[::hop]
        power = np.abs(np.fft.rfft(frames * window, axis=1)) ** 2
        out.append(power @ fold)
    chroma = np.concatenate(out)
    size = np.linalg.norm(chroma, axis=1, keepdims=True)
    return chroma / np.where(size > 1e-6, size, np.inf)


def packed_codes(chroma: np.ndarray) -> np.ndarray:
    """A uint32 for each run of ``WIDTH`` frames."""
    n = len(chroma) - WIDTH + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(chroma) + 1, 13))
    image[1:, 1:] = chroma.cumsum(0).cumsum(1)
    at = np.arange(n)

    def area(t, frames, y, tall):
        a, b = at + t, at + t + frames
        return image[b, y + tall] - image[a, y + tall] - image[b, y] + image[a, y]

    codes = np.zeros(n, np.uint32)
    for kind, y, tall, wide in filter_shapes():
        all_, w, h = area(0, wide, y, tall), wide // 2, max(1, tall // 2)
        if kind == 0:
            plus, minus = all_, area(0, wide, 0, 12) - all_ if tall < 12 else area(0, w, 0, 6)
        elif kind == 1:
            plus, minus = area(0, w, y, tall), area(w, wide - w, y, tall)
        elif kind == 2:
            plus, minus = area(0, wide, y, h), area(0, wide, y + h, tall - h)
        elif kind == 3:
            plus = area(0, w, y, h) + area(w, wide - w, y + h, tall - h)
            minus = all_ - plus
        else:
            plus = area(w // 2, max(1, w), y, tall)
            minus = all_ - plus
        value = np.log1p(plus) - np.log1p(minus)
        level = (value > -0.4).astype(np.uint32) + (value > 0) + (value > 0.4)
        codes = (codes << np.uint32(2)) | (level ^ (level >> np.uint32(1)))
    return codes


def tones(text: str | None) -> np.ndarray:
    """Samples of a text played word by word, one note of ``HOP`` samples each."""
    words = (text or "").split()
    t = np.arange(HOP) / RATE
    pitch = 220 * 2 ** (np.arange(24) / 12)
    notes = (np.sin(2 * np.pi * pitch[:, None] * t) + 0.3 * np.sin(4 * np.pi * pitch[:, None] * t)).astype(np.float32)
    return notes[[zlib.crc32(w.encode()) % 24 for w in words]].ravel() if words else np.zeros(0, np.float32)


def pcm(audio: bytes | None) -> np.ndarray:
    """Samples of 16-bit little-endian mono audio."""
    return np.frombuffer(audio or b"", "<i2", len(audio or b"") // 2).astype(np.float32) / 32768


def fingerprints(recordings: DataFrame, column: str, samples=pcm, rate: int = RATE) -> DataFrame:
    """(rec_id, codes): packed codes of a media column, 4 bytes little-endian each."""
    schema = T.StructType([recordings.schema["rec_id"]]).add("codes", "binary")

    def batches(frames):
        for frame in frames:
            for at in range(0, len(frame), 500):
                part = frame.slice(at, 500)
                codes = [packed_codes(pitch_classes(samples(x), rate)).astype("<u4").tobytes() for x in part[column].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["rec_id"], pa.array(codes, pa.binary())], ["rec_id", "codes"])

    return recordings.select("rec_id", column).mapInArrow(batches, schema)


def laid_out(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of some classes one after another, the row of each code and its place in the row."""
    sizes = np.array([len(x) // 4 for x in column.to_pylist()], np.int64)
    codes = np.frombuffer(b"".join(column.to_pylist()), "<u4")
    row = np.repeat(np.arange(len(sizes)), sizes)
    return codes, row, np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def mark_of(code: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Landmarks of codes and those ``WIDTH`` later: neighbours say much the same, so that pairs of them would meet by chance far more often."""
    return (code.astype(np.int64) << 20) | (after >> np.uint32(12))


def landmarks(frames):
    """Task body: (mark, key) for the distinct landmarks of each class."""
    for frame in frames:
        for at in range(0, len(frame), 2000):
            codes, row, _ = laid_out(frame["codes"].slice(at, 2000))
            there = np.flatnonzero(row[WIDTH:] == row[:-WIDTH])
            mark = mark_of(codes[there], codes[there + WIDTH])
            found = np.unique(np.stack([row[there], mark], 1), axis=0) if len(there) else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 1]), frame["key"].slice(at, 2000).take(pa.array(found[:, 0]))], ["mark", "key"])


def contexts(frames):
    """Task body: (mark, context, key, at) for each distinct context of the wanted landmarks of each class."""
    for frame in frames:
        found: list[tuple[int, bytes, int, int]] = []
        for key, packed, marks in zip(frame["key"].to_pylist(), frame["codes"].to_pylist(), frame["marks"].to_pylist(), strict=True):
            codes = np.frombuffer(packed, "<u4")
            mark = mark_of(codes[:-WIDTH], codes[WIDTH:])
            first: dict[tuple[int, bytes], int] = {}
            for p in np.flatnonzero(np.isin(mark, np.array(marks, np.int64))).tolist():
                low, high = min(p, BEFORE), min(len(codes) - p, AFTER)
                first.setdefault((int(mark[p]), bytes([low, high]) + packed[4 * (p - low) : 4 * (p + high)]), p)
            found += [(m, c, key, at) for (m, c), at in first.items()]
            if len(found) > 100_000:
                yield context_rows(found)
                found = []
        if found:
            yield context_rows(found)


def context_rows(found: list[tuple[int, bytes, int, int]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], ["mark", "context", "key", "at"])


def spread_out(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts as rows of codes with the landmark at ``BEFORE``, and their codes before it and from it on."""
    codes = np.zeros((len(packed), BEFORE + AFTER), np.uint32)
    low, high = (np.array([x[k] for x in packed], np.int64) for k in (0, 1))
    for k, x in enumerate(packed):
        codes[k, BEFORE - low[k] : BEFORE + high[k]] = np.frombuffer(x, "<u4", offset=2)
    return codes, low, high


def passes(x, y, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which contexts i of x and j of y have a window with few bit errors: of ``SPAN`` codes, or all of a shorter recording."""
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 15):
        a, b = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
        (cx, lx, hx), (cy, ly, hy) = x, y
        wrong = np.zeros((len(a), BEFORE + AFTER + 1), np.int32)
        np.cumsum(np.bitwise_count(cx[a] ^ cy[b]), axis=1, dtype=np.int32, out=wrong[:, 1:])
        span = np.minimum(SPAN, np.minimum(lx[a] + hx[a], ly[b] + hy[b]))
        first, last = BEFORE - np.minimum(lx[a], ly[b]), BEFORE + np.minimum(hx[a], hy[b])
        k = np.arange(len(a))
        good = np.zeros(len(a), bool)
        for start in range(BEFORE + 1):
            fits = (start >= first) & (start + span <= last)
            stop = np.minimum(start + span, BEFORE + AFTER)
            good |= fits & (wrong[k, stop] - wrong[k, start] <= ERRORS * 32 * span)
        out[at : at + (1 << 15)] = good
    return out


def compared(frames):
    """Task body: links (a, b, shift) that join all contexts of each group which pass with each other.

    The rows of a group come one after another; ``side`` is 0 where a block meets itself, else 0 or 1.
    """

    def links(group):
        sides = [[r for r in group if r[3] == s] for s in (0, 1)]
        if len(group) < 2 or (not sides[0] and sides[1]):
            return
        x = spread_out([r[0] for r in sides[0]])
        y, members = (spread_out([r[0] for r in sides[1]]), sides[0] + sides[1]) if sides[1] else (x, sides[0])
        shift, tops = (len(sides[0]) if sides[1] else 0), list(range(len(members)))
        n, m = len(x[0]), len(y[0])
        step = max(1, (1 << 15) // m)
        for at in range(0, n, step):
            i, j = (g.ravel() for g in np.meshgrid(np.arange(at, min(n, at + step)), np.arange(m), indexing="ij"))
            if not shift:
                i, j = i[i < j], j[i < j]
            roots = np.array([find(tops, k) for k in range(len(tops))])
            apart = roots[i] != roots[j + shift]
            i, j = i[apart], j[apart]
            good = passes(x, y, i, j)
            i, j = i[good], j[good] + shift
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                if find(tops, a) != find(tops, b):
                    forest(tops, np.array([a]), np.array([b]))
                    yield members[a][1], members[b][1], members[b][2] - members[a][2]

    def batch(found):
        kinds = (("a", pa.int64()), ("b", pa.int64()), ("shift", pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, (_, t) in enumerate(kinds)], [n for n, _ in kinds])

    now, group, found = None, [], []
    for frame in frames:
        columns = [frame[c].to_pylist() for c in ("mark", "one", "other", "context", "key", "at", "side")]
        for mark, one, other, *row in zip(*columns, strict=True):
            if (mark, one, other) != now:
                found += links(group)
                now, group = (mark, one, other), []
            group.append(row)
        if found:
            yield batch(found)
            found = []
    yield batch([*found, *links(group)])


def aligned(recordings: DataFrame, column: str, samples=pcm, rate: int = RATE, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Recordings with their class (rec_id, codes, key), and links (a, b, shift, votes) that connect all linked classes.

    ``shift`` is the offset of b against a with most votes of those given, ``votes`` their number.
    """
    rows = cut(fingerprints(recordings, column, samples, rate).withColumn("key", F.xxhash64("codes")))
    with Scratch(recordings.sparkSession) as scratch:
        classes = scratch(rows.where(F.length("codes") > 4 * WIDTH).groupBy("key").agg(F.first("codes").alias("codes")))
        marks = scratch(classes.mapInArrow(landmarks, "mark long, key long"))
        shared = cut(marks.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mark"))
        wanted = marks.join(shared, "mark").groupBy("key").agg(F.collect_list("mark").alias("marks"))
        met = scratch(classes.join(wanted, "key").mapInArrow(contexts, "mark long, context binary, key long, at int"))
        distinct = scratch(met.groupBy("mark", "context").agg(F.min(F.struct("key", "at")).alias("first")).select("mark", "context", "first.*"))
        heads = distinct.select("mark", "context", F.col("key").alias("a"), F.col("at").alias("at_a"))
        equal = met.join(heads, ["mark", "context"]).where("key > a").select("a", F.col("key").alias("b"), (F.col("at") - F.col("at_a")).alias("shift"))
        sizes = distinct.groupBy("mark").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n"))
        sizes = cut(sizes.where("n > 1").drop("n"))
        own = F.pmod(F.xxhash64("context"), F.col("blocks")).cast("int").alias("own")
        every = distinct.join(sizes, "mark").select("*", own).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
        dealt = every.select("mark", F.least("own", "with").alias("one"), F.greatest("own", "with").alias("other"), "context", "key", "at", (F.col("own") > F.col("with")).cast("int").alias("side"))
        groups = ["mark", "one", "other"]
        near = dealt.repartition(*groups).sortWithinPartitions(*groups).mapInArrow(compared, "a long, b long, shift int")
        votes = equal.union(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("shift")).otherwise(-F.col("shift")).alias("shift"))
        histogram = votes.where("a < b").groupBy("a", "b", "shift").agg(F.count(F.lit(1)).alias("votes"))
        best = cut(histogram.groupBy("a", "b").agg(F.max(F.struct("votes", "shift")).alias("top")).select("a", "b", "top.shift", "top.votes"))
    return rows, best


def group_recordings(recordings: DataFrame, column: str, samples=pcm, rate: int = RATE) -> DataFrame:
    """(rec_id, n_codes, codes_crc32, component_id) of every recording.

    Two recordings are linked if their codes are equal, or if they have a landmark, an equal
    code and equal upper 20 bits ``WIDTH`` codes later, and at its offset a window of ``SPAN`` codes around it, or all
    of a shorter recording, has at most 15 % bit errors.  ``component_id`` is the
    smallest id reachable.

    Defined results: null, empty and silent or too short audio without a code links with
    nothing; repeated rows are linked; a recording without an id is linked like any other
    and its id counts for nothing; no rows give no rows; further columns are ignored.
    Frames are worked out some thousand at a time, so that long recordings need no more
    memory than their samples and codes.
    """
    rows, pairs = aligned(recordings, column, samples, rate)
    firsts = rows.where(F.length("codes") > 0).groupBy("key").agg(F.min("rec_id").alias("first"))
    linked = components(pairs.select("a", "b"))
    rooted = cut(firsts.join(linked.withColumnRenamed("node", "key"), "key", "left").select("key", "first", F.coalesce("root", "key").alias("root")))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = cut(rooted.join(lowest, "root").select("key", "component_id"))
    sound, silent = rows.where("length(codes) > 0").join(labels, "key"), rows.where("length(codes) = 0")
    out = sound.select("rec_id", "codes", "component_id").union(silent.select("rec_id", "codes", "rec_id"))
    return out.select("rec_id", (F.length("codes") / 4).cast("long").alias("n_codes"), F.crc32("codes").alias("codes_crc32"), "component_id")
