"""Secret scans: known shapes of credentials, and strings that a token vocabulary finds hard to write.

A vocabulary learnt from ordinary text writes words, names and numbers with few tokens.
Random strings cost it a token for every one or two characters.  Unbroken runs of letters,
digits and the signs of Base64 are therefore encoded, and those with few characters a
token are reported as ``dense``, unless they are known digests or identifiers: numbers,
UUIDs, hexadecimal digests of the usual lengths, subresource digests, and words, alone or
joined as in paths and names of a program.

Three kinds of known shapes are found besides, whatever their tokens: assignments to
password-like names (``assign``), access keys (``access``) and long hexadecimal strings
(``hex``).  A dense run that touches one of their spans adds nothing and is left out.

Defined results: null, empty and blank texts have no spans; texts and runs of any length
are scanned whole (runs are encoded in blocks of ``BLOCK`` characters); offsets count code
points, ends are exclusive; every row, repeated or with a null id, has its own spans; an
empty table gives no rows; further columns take no part, ``redacted`` keeps them.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .token_counts import byte_encoder
from .tokens import slices, vocabulary

#: The shapes of known secrets, and how long they must be at least.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
NAMES = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE, LEAST_ACCESS = 8, 16
#: The kinds, in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "dense")

#: Characters of a run, and most characters a token for it to be dense.
LEAST_RUN, MOST_RATIO = 20, 2.0
#: Characters of a long run that are encoded at a time.
BLOCK = 4096

RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}")
#: What is dense but no secret: numbers and times, UUIDs, digests (MD5, SHA-1, SHA-2), words joined by signs or capitals, with numbers of up to 4 digits.
WORD = r"(?:[A-Z]?[a-z]{2,}(?:[A-Z]{2,4}(?=[A-Z][a-z])|[A-Z][a-z]{2,})*(?:[A-Z]{2,4})?|[A-Z]{2,4}(?:[A-Z][a-z]{2,})+|[A-Z]{2,}|[A-Za-z])"
KNOWN = re.compile(
    r"[0-9+/_=-]+(?:T[0-9-]+Z?)?"
    r"|[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"
    r"|(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})"
    r"|(?:[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{56}|[0-9A-F]{64}|[0-9A-F]{96}|[0-9A-F]{128})"
    r"|sha(?:256|384|512)-[A-Za-z0-9+/_-]+=*"
    rf"|[+/_=-]*{WORD}[0-9]{{0,4}}(?:[+/_=-]+(?:{WORD}|[0-9])[0-9]{{0,4}})*[+/_=-]*"
)


def ratio(encoder, run: str) -> float:
    """Characters a token."""
    return len(run) / sum(len(encoder.encode_ordinary(run[i : i + BLOCK])) for i in range(0, len(run), BLOCK))


def known_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the known shapes."""
    low, found = text.lower(), []
    if any(name in low for name in NAMES):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def all_spans(text: str, encoder, most_ratio: float = MOST_RATIO) -> list[tuple[int, str, int]]:
    """The known shapes and the dense runs beside them."""
    found, dense, k, reach = known_spans(text), [], 0, 0
    for m in RUN.finditer(text):
        while k < len(found) and found[k][0] < m.end():
            reach, k = max(reach, found[k][2]), k + 1
        if reach <= m.start() and not KNOWN.fullmatch(m[0]) and ratio(encoder, m[0]) <= most_ratio:
            dense.append((m.start(), "dense", m.end()))
    return sorted(found + dense, key=lambda s: (s[0], KINDS.index(s[1])))


def marked(text: str | None, spans: list[tuple[int, str, int]]) -> str | None:
    """The text with ``[kind]`` in place of each span; of spans that overlap the first names the kind of all."""
    out, at, reach = [], 0, 0
    for start, kind, end in spans:
        if start >= reach:
            out += [text[max(at, reach) : start], f"[{kind}]"]
        at = reach = max(reach, end)
    return None if text is None else "".join([*out, text[reach:]])


def find(docs: DataFrame, column: str = "text", *, carry: list[str] = (), redact: bool = False, path: str | None = None, most_ratio: float = MOST_RATIO) -> DataFrame:
    """(*carry, spans[, redacted]) of every row; spans are (start, kind, end) by start, then kind."""
    path = path or vocabulary("byte_bpe_50k.tiktoken")
    fields = docs.select(*[F.col(f"`{c}`") for c in carry]).schema.fields if carry else []
    span = T.StructType().add("start", "long").add("kind", "string").add("end", "long")
    # columns go by place inside, so that carried ones may have any name
    schema = T.StructType([T.StructField(f"_{i}", f.dataType) for i, f in enumerate(fields)]).add("spans", T.ArrayType(span))
    schema = schema.add("redacted", "string") if redact else schema
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(path)[0]
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for first, last in slices(texts):
                some = texts.slice(first, last - first).to_pylist()
                spans = [all_spans(t, encoder, most_ratio) if t else [] for t in some]
                out = [*[batch.column(i).slice(first, last - first) for i in range(batch.num_columns - 1)]]
                out.append(pa.array([[{"start": a, "kind": k, "end": b} for a, k, b in row] for row in spans], kind))
                if redact:
                    out.append(pa.array([marked(t, s) for t, s in zip(some, spans, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(out, schema.names)

    apart = docs.select(*[F.col(f"`{f.name}`").alias(f"_{i}") for i, f in enumerate(fields)], F.col(f"`{column}`").alias("_text"))
    return apart.mapInArrow(scan, schema).toDF(*[f.name for f in fields], *schema.names[len(fields) :])


def redacted(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with ``[kind]`` in place of every secret of ``text``."""
    found = find(docs.select("text", F.struct("*").alias("_own")), carry=["_own"], redact=True, **options)
    return found.select(*[F.col("redacted" if c == "text" else f"_own.`{c}`").alias(c) for c in docs.columns])


def listed(spans) -> F.Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans, *kinds: str) -> F.Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))
