"""Token counts: offset-mapped attribution of tokens to sections.

Each document is encoded once, whole, so that tokens are those of the document and not
of its pieces.  The byte lengths of the tokens give their offsets, and an interval join
of the sorted token spans with the sorted section spans finds the sections each token
touches.  Tokens that cross a boundary are allocated by an explicit rule.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .tokens import vocabulary

#: ``start``: the section of its first character; ``majority``: the one with most of its
#: characters, the earlier of equals; ``split``: each by its share of the characters.
RULES = ("start", "majority", "split")
#: The tokenizer takes such a run, without its last blank if more text follows, as one piece; its pattern matcher would run out of stack on it.
LONG_BLANKS = re.compile("[\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


@functools.lru_cache(maxsize=2)
def byte_encoder(path: str):
    """A byte-level BPE from a rank file, with the byte length of each of its tokens."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def token_ids(encoder, text: str) -> np.ndarray:
    """Tokens of a whole text; long blank runs are cut out at the piece boundaries they have anyway."""
    parts, at = [], 0
    for run in LONG_BLANKS.finditer(text):
        stop = run.end() - (run.end() < len(text))
        parts += [encoder.encode_to_numpy(text[at : run.start()]), np.array(encoder._encode_single_piece(text[run.start() : stop]), np.uint32)]
        at = stop
    return np.concatenate([*parts, encoder.encode_to_numpy(text[at:])]).astype(np.int64)


def token_spans(encoder, lengths: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of each token; a token with part of a character's bytes spans that character."""
    size = lengths[token_ids(encoder, text)]
    ends = np.cumsum(size)
    raw = text.encode()
    if len(raw) == len(text):
        return ends - size, ends
    character = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1
    return character[ends - size], character[ends - 1] + 1


def lines_of(text: str) -> np.ndarray:
    """First characters of the lines of a text; a line keeps its line feed."""
    starts = [0]
    at = text.find("\n")
    while 0 <= at < len(text) - 1:
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    return np.array(starts, np.int64)


def allocate(first: np.ndarray, end: np.ndarray, starts: np.ndarray, stop: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens allocated to each of the adjoining sections that begin at ``starts``, and crossing tokens that touch each."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    a = np.searchsorted(starts, first, side="right") - 1
    b = np.searchsorted(starts, end - 1, side="right") - 1
    whole = a == b
    counts = np.bincount(a[whole], minlength=len(starts)).astype(float)
    crossing = np.zeros(len(starts), np.int64)
    bounds = np.append(starts, stop)
    for x, y, s, e in zip(a[~whole].tolist(), b[~whole].tolist(), first[~whole].tolist(), end[~whole].tolist(), strict=True):
        share = np.minimum(bounds[x + 1 : y + 2], e) - np.maximum(bounds[x : y + 1], s)
        crossing[x : y + 1] += 1
        if rule == "split":
            counts[x : y + 1] += share / (e - s)
        else:
            counts[x + (int(share.argmax()) if rule == "majority" else 0)] += 1
    return counts, crossing


def count_by_section(docs: DataFrame, rule: str = "majority", path: str | None = None, sections: str | None = None) -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_crossing) for each section of each row.

    Sections are the lines of the text, or begin at the characters listed in the column
    ``sections`` (an array of increasing integers; what comes before the first belongs to
    it).  ``n_tokens`` is a double, whole but for the rule ``split``; over a document it adds
    up to the tokens of the whole text.

    Defined results: a null or empty text is one section without tokens; repeated rows are
    counted each; no rows give no rows; further columns are ignored.
    """
    path = path or vocabulary("byte_bpe_50k.tiktoken")
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)]).add("section", "integer")
    schema = schema.add("start", "long").add("end", "long").add("n_tokens", "double").add("n_crossing", "long")

    def rows_of(text, begins, encoder, lengths):
        text = text or ""
        starts = lines_of(text) if begins is None else np.array([0, *[b for b in begins[1:] if 0 < b < len(text)]], np.int64)
        if not text:
            return starts[:1], np.zeros(1, np.int64), np.zeros(1), np.zeros(1, np.int64)
        counts, crossing = allocate(*token_spans(encoder, lengths, text), starts, len(text), rule)
        return starts, np.append(starts[1:], len(text)), counts, crossing

    def batches(frames):
        encoder, lengths = byte_encoder(path)
        for frame in frames:
            begins = frame[sections].to_pylist() if sections else [None] * len(frame)
            texts = frame["text"].to_pylist()
            for at in range(0, len(frame), 1000):
                made = [rows_of(t, b, encoder, lengths) for t, b in zip(texts[at : at + 1000], begins[at : at + 1000], strict=True)]
                sizes = [len(m[0]) for m in made]
                ids = frame["doc_id"].slice(at, 1000).take(pa.array(np.repeat(np.arange(len(made)), sizes)))
                section = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
                columns = [np.concatenate([m[k] for m in made]) for k in range(4)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(section), *map(pa.array, columns)], schema.names)

    return docs.select("doc_id", "text", *([sections] if sections else [])).mapInArrow(batches, schema)
