"""Reference-free quality scores of a translation against its source."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import COMPATIBLE, EngineConfig
from .text import word_count


BLANK = re.compile("[\\t\\n\\x0b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+")
#: Pairs of a batch that a task has as Python objects at a time, and characters of pairs whose scores it remembers.
AT_ONCE, MOST_HELD = 50, 1_000_000


def _f_score(precision: float, recall: float) -> float:
    return 2 * precision * recall / (precision + recall) if precision + recall else 0.0


def _overlap(candidate: str, reference: str) -> float:
    have, want = ([w for w in BLANK.split(t or "") if w] for t in (candidate, reference))
    if not have or not want:
        return 0.0
    known = {w.lower() for w in want}
    shared = sum(w.lower() in known for w in have)
    return _f_score(shared / len(have), shared / len(want))


def _grams(text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct lower-cased n-grams of UTF-16 units, up to four packed in a number, and their counts."""
    low = text.lower()
    if n > 4 or len(low) != len(text) or "\u03a3" in text or (not text.isascii() and max(text) > "\uffff"):
        return _grams_apart(text, n)
    unit = np.frombuffer(low.encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint64)
    packed = np.zeros(max(0, len(unit) - n + 1), np.uint64)
    for k in range(n):
        packed = (packed << np.uint64(16)) | unit[k : k + len(packed)]
    return np.unique(packed, return_counts=True)


def _grams_apart(text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``_grams`` for texts with letters whose lower case depends on what is beside them: each n-gram is lowered alone."""
    units = text.encode("utf-16-le", "surrogatepass")
    text = "".join(chr(int.from_bytes(units[i : i + 2], "little")) for i in range(0, len(units), 2))
    seen: dict = {}
    for i in range(len(text) - n + 1):
        gram = text[i : i + n].lower()
        key = int.from_bytes(gram.encode("utf-16-be", "surrogatepass"), "big") if len(gram) == n <= 4 else gram
        seen[key] = seen.get(key, 0) + 1
    keys = np.empty(len(seen), object)
    keys[:] = list(seen)
    return keys, np.fromiter(seen.values(), np.int64, len(seen))


def _character_f(candidate: str, reference: str, n: int) -> float:
    if not candidate or not reference:
        return 0.0
    (a, a_n), (b, b_n) = _grams(candidate, n), _grams(reference, n)
    if object in (a.dtype, b.dtype):
        known = dict(zip(b.tolist(), b_n.tolist(), strict=True))
        shared = sum(min(k, known.get(g, 0)) for g, k in zip(a.tolist(), a_n.tolist(), strict=True))
    else:
        _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        shared = int(np.minimum(a_n[i], b_n[j]).sum())
    return _f_score(shared / int(a_n.sum()), shared / int(b_n.sum())) if shared else 0.0


def pair_scores(candidates: pa.Array, references: pa.Array, n: int) -> Iterator[tuple[float, float]]:
    """The two F scores of each pair; a few texts of a batch are Python objects at a time, and pairs of the last ones are scored once."""
    known: dict[tuple[str, str], tuple[float, float]] = {}
    held = 0
    for first in range(0, len(candidates), AT_ONCE):
        for pair in zip(candidates.slice(first, AT_ONCE).to_pylist(), references.slice(first, AT_ONCE).to_pylist(), strict=True):
            if pair not in known:
                if held > MOST_HELD:
                    known, held = {}, 0
                known[pair] = _overlap(*pair), _character_f(*pair, n)
                held += sum(len(t or "") for t in pair)
            yield known[pair]


def text_scores(candidate: Column, reference: Column, n: int = 4) -> Column:
    """Struct (bleu, chrf): the F scores of shared words and of shared character n-grams.

    A repeated word of the candidate counts each time, so the first can exceed 1.  Sets
    and counts of whole texts are hashed in Arrow batches: array functions search them
    one by one, in time that grows with the square of a text.
    """

    @F.arrow_udf("bleu double, chrf double")
    def score(a: pa.Array, b: pa.Array) -> pa.Array:
        found = list(pair_scores(a, b, n))
        return pa.StructArray.from_arrays([pa.array([f[k] for f in found], pa.float64()) for k in (0, 1)], ["bleu", "chrf"])

    return score(candidate, reference)


def length_score(source: Column, translated: Column) -> Column:
    ratio = word_count(translated) / word_count(source)
    return (
        F.when(word_count(source) == 0, 1.0).when(ratio.between(0.5, 2.0), 1.0).when((ratio < 0.3) | (ratio > 3.0), 0.3).otherwise(0.7)
    )


def confidence(bleu: Column, chrf: Column, length: Column, config: EngineConfig = COMPATIBLE) -> Column:
    a, b, c = config.weights
    return bleu * a + chrf * b + length * c


def with_scores(df, source: str, translated: str, config: EngineConfig = COMPATIBLE):
    """``df`` with (bleu, chrf, length_score, confidence, flagged)."""
    s, t = F.coalesce(F.col(source), F.lit("")), F.coalesce(F.col(translated), F.lit(""))
    scored = df.withColumn("_scores", text_scores(t, s)).withColumns({"bleu": F.col("_scores.bleu"), "chrf": F.col("_scores.chrf"), "length_score": length_score(s, t)})
    scored = scored.drop("_scores")
    scored = scored.withColumn("confidence", confidence(F.col("bleu"), F.col("chrf"), F.col("length_score"), config))
    return scored.withColumn("flagged", F.col("confidence") < config.confidence_threshold)
