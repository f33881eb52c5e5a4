"""Toxicity: a linear-chain conditional random field tags toxic words.

Labels are known for whole documents.  Words, and beginnings of words, that occur in
more contexts of toxic documents than chance allows mark the first toxic tokens of a
bounded sample of labelled documents.  The field, which sees a token's word, its
beginnings and both neighbours, is trained on those, and once more on the tokens of toxic
documents that its own marginals find likely.  Forward-backward marginals of its tokens
then add up to a document score and to offending offsets.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import order_key, remainder
from .crf import Chain, fit
from .tokens import distinct_words, slices

#: Most labelled documents of each label that a model is fitted on, their longest length, and most segments with and without toxic tokens.
FIT_ROWS, FIT_CHARS, FIT_SEGMENTS = 1000, 100_000, 1500
STEMS = (4, 5, 6)
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))


def plain(word: str) -> str:
    """A word without case and surrounding punctuation."""
    return word.lower().strip(EDGES)


def own_features(word: str) -> list[str]:
    return [f"w={word}", *(f"{n}={word[:n]}" for n in STEMS if len(word) > n)]


def around(words: list[str], k: int) -> list[str]:
    """The neighbours of token k as features."""
    return [*([f"-1={words[k - 1]}"] if k else []), *([f"+1={words[k + 1]}"] if k + 1 < len(words) else [])]


@dataclass
class Model:
    chain: Chain
    #: document score: sigmoid(scale[0] + scale[1] * log odds that any token is toxic)
    scale: tuple[float, float]


def plain_words(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct plain words, the number of each token's word, number of tokens of each text)."""
    words, which, sizes = distinct_words(pa.array(texts, pa.string()))
    names: dict[str, int] = {}
    code = np.array([names.setdefault(plain(w), len(names)) for w in words.to_pylist()], np.int64)
    return list(names), code[which], sizes


def marked_words(names: list[str], ids: np.ndarray, sizes: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Words with a feature that occurs in more distinct contexts of toxic documents than chance allows.

    A context is the word before and after, so that copies of a document count once.
    """
    doc = np.repeat(np.arange(len(sizes)), sizes)
    same = np.concatenate([[False], doc[1:] == doc[:-1], [False]])
    before, after = np.where(same[:-1], np.roll(ids, 1) + 1, 0), np.where(same[1:], np.roll(ids, -1) + 1, 0)
    context = (before << 42) ^ (ids << 21) ^ after
    first, totals = np.zeros((2, len(names)), np.int64), [0, 0]
    for label in (0, 1):
        _, at = np.unique(context[toxic[doc] == label], return_index=True)
        first[label], totals[label] = np.bincount(ids[toxic[doc] == label][at], minlength=len(names)), len(at)
    share, marked = totals[1] / max(1, sum(totals)), set()
    if not 0 < share < 1:
        return np.zeros(len(names), bool)
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for k in np.flatnonzero(first[1]).tolist():
        for f in own_features(names[k]):
            seen[1][f] += int(first[1][k])
    for k in np.flatnonzero(first[0]).tolist():
        for f in own_features(names[k]):
            if f in seen[1]:
                seen[0][f] += int(first[0][k])
    limit = -math.log(len(seen[1]) + 1) - 3
    for f, t in seen[1].items():
        n = t + seen[0][f]
        if t >= 2 and t > share * n:
            p = t / n  # Chernoff bound of the binomial tail
            tail = -n * (t / n * math.log(p / share) + ((n - t) / n * math.log((1 - p) / (1 - share)) if t < n else 0.0))
            if tail < limit and p > 0.8:
                marked.add(f)
    return np.array([not marked.isdisjoint(own_features(w)) for w in names], bool)


def train(texts: list[str], toxic: list[int], most: int = FIT_SEGMENTS, length: int = 64) -> Model:
    """Fit the field and the document score on labelled texts.

    At most ``most`` segments of ``length`` words with toxic tokens and as many without
    are used, chosen by a hash of their words from all texts.
    """
    names, ids, sizes = plain_words(texts)
    label = np.array(toxic, np.int64)
    hit = marked_words(names, ids, sizes, label)[ids] & (np.repeat(label, sizes) == 1) if len(ids) else np.zeros(0, bool)
    parts = [(at, min(at + length, end), d) for d, (end, n) in enumerate(zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True)) for at in range(end - n, end, length)]
    order = lambda p: zlib.crc32(" ".join(names[k] for k in ids[p[0] : p[1]].tolist()).encode("utf-8", "surrogatepass"))
    chosen = [p for some in (True, False) for p in sorted((p for p in parts if hit[p[0] : p[1]].any() == some), key=order)[:most]]
    words = [[names[k] for k in ids[a:b].tolist()] for a, b, _ in chosen]
    labels = [hit[a:b].astype(int).tolist() for a, b, _ in chosen]
    if not any(map(any, labels)):
        return Model(Chain(start=np.array([0.0, -4.0])), (-2.0, 0.5))
    for last in (False, True):
        seen: Counter = Counter()
        for some, y in zip(words, labels, strict=True):
            for k in np.flatnonzero(y).tolist():
                seen.update((*own_features(some[k]), *around(some, k)))
        useful = {f for f, n in seen.items() if f[0] not in "+-" or n > 2}  # a neighbour has to be met often
        sequences = [[["bias", *(f for f in (*own_features(w), *around(some, k)) if f in useful)] for k, w in enumerate(some)] for some in words]
        chain = fit(sequences, labels)
        if not last:  # the tokens of toxic documents that the field itself takes for toxic
            lengths = np.array(list(map(len, words)), np.int64)
            odds = np.split(chain.marginals(chain.emissions([fs for q in sequences for fs in q]), lengths), np.cumsum(lengths)[:-1])
            labels = [[int(label[d] and o > 0) for o in own] for (_, _, d), own in zip(chosen, odds, strict=True)]
            if not any(map(any, labels)):
                break
    x = np.clip(document_odds(chain, texts), -20, 20)
    y, a, b = label.astype(float), 0.0, 1.0
    for _ in range(50):  # Newton steps of a penalised logistic regression
        p = 1 / (1 + np.exp(-(a + b * x)))
        weight = p * (1 - p) + 1e-6
        g = np.array([(y - p).sum() - 0.01 * a, ((y - p) * x).sum() - 0.01 * (b - 0.5)])
        h = np.array([[weight.sum() + 0.01, (weight * x).sum()], [(weight * x).sum(), (weight * x * x).sum() + 0.01]])
        d = np.linalg.solve(h, g)
        a, b = a + float(np.clip(d[0], -1, 1)), b + float(np.clip(d[1], -0.5, 0.5))
    return Model(chain, (a, max(b, 0.01)))


def any_toxic(log_odds: np.ndarray) -> float:
    """Log odds that at least one token is toxic, taking their marginals as independent."""
    if not len(log_odds):
        return -20.0
    none = -np.logaddexp(0, log_odds).sum()  # log of the product of (1 - p)
    if none > -1e-9:
        return math.log(max(-none, 1e-9))
    return float(np.log(-np.expm1(none)) - none)


def document_odds(chain: Chain, texts: list[str]) -> np.ndarray:
    """Log odds that a text has a toxic token, for some texts at a time."""
    tagger, out = Tagger(Model(chain, (0.0, 1.0))), []
    column = pa.array(texts, pa.string())
    for first, last in slices(column, 1 << 20):
        e, sizes = tagger.emissions(column.slice(first, last - first))
        odds, ends = chain.marginals(e, sizes), np.cumsum(sizes)
        out += [any_toxic(odds[b - n : b]) for b, n in zip(ends, sizes, strict=True)]
    return np.array(out)


class Tagger:
    """Scores texts; the weights of each distinct word of a batch are looked up once."""

    def __init__(self, model: Model):
        self.model = model

    def emissions(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Emissions of all tokens of all texts, one text after another, and the number of tokens of each."""
        get = self.model.chain.weights.get
        words, which, sizes = distinct_words(texts)
        weights = np.zeros((3, len(words)))  # as the token itself, before it, after it
        for k, word in enumerate(map(plain, words.to_pylist())):
            weights[:, k] = sum(get(f, 0.0) for f in own_features(word)), get(f"-1={word}", 0.0), get(f"+1={word}", 0.0)
        e = get("bias", 0.0) + weights[0][which]
        ends = np.cumsum(sizes)
        inner = np.ones(len(which), bool)  # tokens that are not the first of their text
        inner[(ends - sizes)[sizes > 0]] = False
        after = np.flatnonzero(inner)
        e[after] += weights[1][which[after - 1]]
        e[after - 1] += weights[2][which[after]]
        return e, sizes

    def tag(self, texts: pa.Array) -> list[tuple[float, list[dict]]]:
        """(score, spans) of each text; a span is (start, end, p) in characters, with p of its likeliest token."""
        flat, sizes = self.emissions(texts)
        odds = self.model.chain.marginals(flat, sizes)
        a, b = self.model.scale
        out, at = [], 0
        for k, n in enumerate(sizes.tolist()):
            own = odds[at : at + n]
            at += n
            z = a + b * min(20.0, max(-20.0, any_toxic(own)))
            spans = []
            if n and own.max() > 0:
                last = -2
                for k, m in enumerate(TOKEN.finditer(texts[k].as_py())):
                    if own[k] > 0:
                        p = float(1 / (1 + np.exp(-own[k])))
                        if k == last + 1:
                            spans[-1].update(end=m.end(), p=max(p, spans[-1]["p"]))
                        else:
                            spans.append({"start": m.start(), "end": m.end(), "p": p})
                        last = k
            out.append((1 / (1 + math.exp(-z)), spans))
        return out


def fit_on(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> Model:
    """A model from at most ``rows`` labelled documents of each label with at most ``chars`` characters.

    Only rows whose crc32(doc_id as text) modulo 5 is not 0 are used; they are chosen by a
    hash of their id.
    """
    known = labels.where(remainder(F.col("doc_id")) != 0).where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    usable = docs.where((remainder(F.col("doc_id")) != 0) & (F.length("text") <= chars))
    there = known.join(usable.select("doc_id"), "doc_id", "left_semi")
    ids = [there.where(F.col("_toxic") == label).orderBy(order_key(F.col("doc_id"))).limit(rows) for label in (0, 1)]
    chosen = [(r["doc_id"], r["_toxic"]) for some in ids for r in some.collect()]  # at most 2 * rows ids
    chosen = docs.sparkSession.createDataFrame(chosen, "doc_id long, _toxic int")
    texts = usable.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("_toxic", "doc_id").agg(F.min("text").alias("text"))
    picked = sorted((r["_toxic"], r["doc_id"], r["text"]) for r in texts.collect())  # at most 2 * rows * chars characters
    return train([t for _, _, t in picked], [y for y, _, _ in picked])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` plus (score, predicted, spans).

    ``score`` in 0..1 rises with the likelihood of label 1, ``predicted`` is 1 from a
    score of 0.5, ``spans`` are the offending stretches as character offsets.

    Defined results: a null or empty text gets the score of a text without toxic words
    and no spans; repeated rows are scored alike; no rows give no rows; columns named
    score, predicted or spans are replaced.
    """
    own = ["score", "predicted", "spans"]
    others = [c for c in docs.columns if c not in own]
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
    schema = docs.select(*[f"`{c}`" for c in others]).schema
    where = T.StructType().add("start", "integer").add("end", "integer").add("p", "double")
    schema = schema.add("score", "double").add("predicted", "integer").add("spans", T.ArrayType(where))

    def batches(frames):
        tagger = Tagger(model)
        for frame in frames:
            for first, last in slices(frame["text"]):
                part = frame.slice(first, last - first)
                found = tagger.tag(part["text"])
                scores = [s for s, _ in found]
                added = [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array([x for _, x in found], span)]
                yield pa.RecordBatch.from_arrays([*[part[c] for c in others], *added], [*others, *own])

    return docs.select(*[f"`{c}`" for c in others]).mapInArrow(batches, schema)


def keep_clean(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the model does not reject, with their columns unchanged."""
    names = docs.columns
    apart = docs.toDF(*[c if c == "text" else f"__own_{k}" for k, c in enumerate(names)])  # clear of the columns that score adds
    return score(apart, fit_on(docs, labels, **options)).where("predicted = 0").drop("score", "predicted", "spans").toDF(*names)
