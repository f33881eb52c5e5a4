"""Best-fit packing: length patterns fitted to the histogram by non-negative least squares.

Documents become token pieces of at most one sequence.  The histogram of piece
lengths has at most ``room`` bins whatever the corpus, so the plan is made on the
driver from it alone: patterns of a few lengths that fill a sequence are enumerated,
their repeat counts are fitted to the histogram by non-negative least squares and
rounded down, and what is left is packed best-fit, one pattern at a time.  Ranking
the pieces of each length then gives every piece its sequence and its place.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, order_key, running_total
from .tokens import slices, vocabulary, word_encoder

ROOM, END = 4096, 1
#: Sequences of a window at least, and windows at most.
WINDOW, WINDOWS = 4096, 64


def token_pieces(docs: DataFrame, path: str, room: int = ROOM, end: int = END, with_ids: bool = False, order: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, order][, ids]) of every document; only longer ones than ``room`` are cut.

    ``order`` names a column of longs that goes along with the pieces.
    """

    def cut_up(batches):
        encoder = word_encoder(path)
        for batch in batches:
            for first, last in slices(batch["text"], 2 << 20):  # small, as the arrays of a part are many times its size
                ids, sizes = encoder.encode(batch["text"].slice(first, last - first))
                ends, rows = np.cumsum(sizes).tolist(), []
                given = [batch[c].slice(first, last - first).to_pylist() for c in ("doc_id", *also)]
                for stop, size, doc_id, *at_order in zip(ends, sizes.tolist(), *given, strict=True):
                    own = np.append(ids[stop - size : stop], np.uint32(end)).astype("<u4")
                    for k, at in enumerate(range(0, len(own), room)):
                        piece = own[at : at + room]
                        row = (doc_id, k, at, len(piece), zlib.crc32(piece.tobytes()), *at_order)
                        rows.append((*row, piece) if with_ids else row)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    also = [order] if order else []
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *also, *["ids"] * with_ids]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.int64()] * len(also), *[pa.list_(pa.int32())] * with_ids]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + "".join(f", `{c}` long" for c in also) + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text", *also).mapInArrow(cut_up, schema)


def few_document_patterns(hist: np.ndarray, choices: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Patterns of two to four lengths that fill a sequence exactly: (pattern number, length) of each member.

    Every length is the first of some pattern if its gaps allow it; further members come from
    evenly spaced quantiles of the histogram, and the last one is what is left to fill.
    """
    room = len(hist) - 1
    there = np.flatnonzero(hist)
    there = there[there < room]
    if not len(there):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mass = np.cumsum(hist[there])
    middle = np.unique(there[np.minimum(np.searchsorted(mass, mass[-1] * (np.arange(choices) + 0.5) / choices), len(there) - 1)])
    number, lengths, first = [], [], 0
    for extra in (0, 1, 2):
        grids = np.meshgrid(there, *[middle] * extra, indexing="ij")
        flat = np.stack([g.ravel() for g in grids], 1)
        space = room - flat.sum(1)
        fills = (space > 0) & (hist[np.maximum(space, 0)] > 0)
        rows = np.sort(np.column_stack([flat[fills], space[fills]]), 1)
        rows = rows[np.unique(rows @ (room + 1) ** np.arange(extra + 2), return_index=True)[1]]
        number.append(np.repeat(first + np.arange(len(rows)), rows.shape[1]))
        lengths.append(rows.ravel())
        first += len(rows)
    return np.concatenate(number), np.concatenate(lengths)


def non_negative_least_squares(number: np.ndarray, lengths: np.ndarray, hist: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Repeat counts x >= 0 that bring the lengths used near the histogram in least squares, by multiplicative updates."""
    n = int(number.max()) + 1 if len(number) else 0
    goal = np.bincount(number, hist[lengths], n)
    x = np.bincount(number, hist[lengths] / np.maximum(1, np.bincount(lengths, minlength=len(hist)))[lengths], n) / 2
    for _ in range(rounds):
        use = np.bincount(lengths, x[number], len(hist))
        x *= goal / np.maximum(np.bincount(number, use[lengths], n), 1e-12)
    return x


def rounded(x: np.ndarray) -> np.ndarray:
    """Whole numbers whose running sum stays within a half of that of ``x``, so that many small counts do not all become 0."""
    return np.diff(np.floor(np.cumsum(x) + 0.5), prepend=0).astype(np.int64)


def fitted_patterns(left: np.ndarray, fits: int = 40, enough: float = 0.05) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is used, taken off the histogram ``left``.

    Rounded counts ask for more pieces of some lengths than there are, so what is left is
    fitted again, until only the share ``enough`` of the pieces is left or no pattern fits.
    """
    plan, most = [], enough * left.sum()
    for _ in range(fits):
        number, lengths = few_document_patterns(left)
        counts = rounded(non_negative_least_squares(number, lengths, left.astype(float)))
        bounds, before = np.searchsorted(number, np.arange(len(counts) + 1)), len(plan)
        for p in np.flatnonzero(counts):
            members, times = np.unique(lengths[bounds[p] : bounds[p + 1]], return_counts=True)
            often = int(min(counts[p], (left[members] // times).min()))
            if often > 0:
                left[members] -= often * times
                plan.append((tuple(np.repeat(members, times).tolist()), often))
        if len(plan) == before or left.sum() <= most:
            break
    return plan


def pattern_plan(hist: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is used; together they use every piece of the histogram exactly once."""
    room, left, plan = len(hist) - 1, hist.astype(np.int64).copy(), []
    if left[room]:
        plan.append(((room,), int(left[room])))
        left[room] = 0
    plan += fitted_patterns(left)
    there = np.flatnonzero(left).tolist()
    while there:
        first = there[-1]
        pattern, space, at = {first: 1}, room - first, len(there) - 1
        while space > 0 and at >= 0:
            at = min(at, int(np.searchsorted(there, space, side="right")) - 1)
            if at < 0:
                break
            size = there[at]
            more = min(space // size, int(left[size]) - pattern.get(size, 0))
            if more > 0:
                pattern[size] = pattern.get(size, 0) + more
                space -= more * size
            at -= 1
        often = min(int(left[s]) // k for s, k in pattern.items())
        for s, k in pattern.items():
            left[s] -= often * k
        plan.append((tuple(s for s, k in sorted(pattern.items(), reverse=True) for _ in range(k)), often))
        there = [s for s in there if left[s]]
    return plan


def slots(plans: list[list[tuple[tuple[int, ...], int]]], room: int = ROOM) -> dict[str, np.ndarray]:
    """For each member of each pattern: its bin, the rank of its first piece there, its first sequence and its offset.

    There is one plan for each window, whose sequences follow those of the window before; the
    bin of a length is ``window * (room + 1) + length``.
    """
    bins, rank, sequence, offset, used, first = [], [], [], [], {}, 0
    for window, plan in enumerate(plans):
        for lengths, often in plan:
            at = 0
            for size in lengths:
                own = window * (room + 1) + size
                bins.append(own)
                rank.append(used.get(own, 0))
                sequence.append(first)
                offset.append(at)
                used[own] = used.get(own, 0) + often
                at += size
            first += often
    order = np.lexsort((rank, bins)) if bins else []
    return {k: np.asarray(v, np.int64)[order] for k, v in (("bin", bins), ("rank", rank), ("sequence", sequence), ("offset", offset))}


def place(pieces: DataFrame, room: int = ROOM, order: str | None = None, window: int = WINDOW) -> DataFrame:
    """Add (sequence_id, offset) to materialised pieces with a ``length`` of 1 to ``room``.

    Without ``order`` all pieces are packed together.  With it, a column of longs spread over
    [0, 2**60), they are packed window by window, so that sequences follow that order from
    window to window; a window has about ``window`` sequences, and there are at most ``WINDOWS``.
    """
    number = F.lit(0)
    if order:
        tokens = pieces.agg(F.sum("length")).first()[0] or 0
        windows = max(1, min(WINDOWS, tokens // room // window))
        number = F.least(F.floor(F.col(order) / 2.0**60 * windows), F.lit(windows - 1))
    binned = pieces.withColumn("_bin", (number * (room + 1) + F.col("length")).cast("long"))
    hist = np.zeros((windows if order else 1, room + 1), np.int64)
    for own, n in binned.groupBy("_bin").agg(F.count(F.lit(1))).collect():  # at most one row for each length up to room and each window
        hist[divmod(own, room + 1)] = n
    at = slots([pattern_plan(h) for h in hist], room)
    ties = [c for c in ("doc_id", "piece", "ids_crc32") if c in pieces.columns]
    keyed = binned.withColumn("_key", order_key(F.concat_ws(":", "doc_id", "piece", "ids_crc32"))).withColumn("_one", F.lit(1).cast("long"))
    ranked = running_total(keyed, "_bin", "_key", "_one", "_rank", ties, rows=int(hist.sum())).drop("_key", "_one")
    #: the slots are at most a few for each length and pattern, a bounded table
    key = at["bin"] << 40 | at["rank"]

    def look_up(batches):
        for batch in batches:
            own, rank = (batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_bin", "_rank"))
            k = np.searchsorted(key, own << 40 | rank, side="right") - 1
            added = [pa.array(at["sequence"][k] + rank - at["rank"][k]), pa.array(at["offset"][k])]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], *added], [*names, "sequence_id", "offset"])

    names = [c for c in pieces.columns if c != order]
    schema = T.StructType([f for f in pieces.schema if f.name != order]).add("sequence_id", "long").add("offset", "long")
    return ranked.select(*names, "_bin", "_rank").mapInArrow(look_up, schema)


def pack(docs: DataFrame, path: str | None = None, room: int = ROOM, end: int = END, with_ids: bool = False, order: str | None = None, window: int = WINDOW) -> DataFrame:
    """Pack all documents into few sequences of at most ``room`` tokens; one row for each piece.

    With ``order``, a column of longs in [0, 2**60), documents are packed in windows of that order.

    Defined results: a null or empty text is the end id alone; texts longer than
    ``room`` tokens are cut into full pieces and a rest; repeated rows are packed
    separately; pieces of equal length are placed in the order of a hash of their
    id; no rows give no rows; further columns are ignored.
    """
    pieces = cut(token_pieces(docs, path or vocabulary("word_bpe_49k.json"), room, end, with_ids, order))
    return place(pieces, room, order, window)


def in_stored_order(docs: DataFrame, order: str) -> DataFrame:
    """``docs``, as read from Parquet files that Spark wrote, with ``order``: the place of each row in their order, spread over [0, 2**60).

    Files of one table follow each other by the numbers of their parts, which a sort makes about
    equally large.  Only the last number and the most rows of a file reach the driver.
    """
    part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1)
    part, row = F.coalesce(F.nullif(part, F.lit("")), F.lit("0")).cast("double"), F.col("_metadata.row_index").cast("double")
    last, most = docs.select(F.max(part), F.max(row)).first()
    place = (part + row / F.lit((most or 0.0) + 1)) / F.lit((last or 0.0) + 1)
    return docs.withColumn(order, (place * 2.0**60).cast("long"))
