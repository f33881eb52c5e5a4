"""Words and token ids inside tasks, worked out for each distinct word once.

Vocabulary files are read from a given path, never copied.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: White space beyond ASCII, which the tokenizer drops like blanks.
WIDE_BLANKS = r"[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Words that Arrow and the tokenizer lower and cut alike: letters of one code point whose lower case is one, and no added token.
UNLIKE = r"[^!-~\x{A1}-\x{12F}\x{131}-\x{17E}\x{180}-\x{24F}]|<\|"
NOT_LETTERS = r"[^a-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]"
#: Fixed value: the tokenizer's own pattern of the pieces of a lower-cased word.
PIECE = r"('s|'t|'re|'ve|'m|'ll|'d|\pL+|\pN|[^\s\pL\pN]+)"


def slices(texts: pa.Array, most: int = 4 << 20):
    """Row ranges of a text column with about ``most`` bytes each."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, first = np.cumsum(sizes), 0
    while first < len(texts):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield first, last
        first = last


def distinct_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, number of each word's entry in text order, number of words of each text); words lie between ASCII blanks."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = split.flatten()
    there = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))])
    ends = before[np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))] if len(split) else np.zeros(0, np.int64)
    coded = flat.filter(there).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), np.diff(ends, prepend=0)


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` that begin at ``starts``, one after another."""
    after = np.cumsum(sizes)
    return values[np.repeat(starts - (after - sizes), sizes) + np.arange(after[-1] if len(after) else 0)]


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE writes for each byte: printable ones for themselves, the others in order from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {**{b: chr(b) for b in printable}, **{b: chr(256 + k) for k, b in enumerate(others)}}


class Remembered:
    """Ids of texts by a function that codes many at once; texts met repeatedly are remembered, up to ``most`` of them."""

    def __init__(self, code, most: int):
        self.code, self.most = code, most
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def __call__(self, texts: list[str], again: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, size): where the ids of each text lie; ``again`` marks texts that are worth remembering."""
        at = np.fromiter((self.place.get(t, -1) for t in texts), np.int64, len(texts))
        fresh = np.flatnonzero(at < 0)
        ids, size = self.code([texts[k] for k in fresh])
        sizes = np.concatenate([np.diff(self.ends, prepend=0), size])
        ids = np.concatenate([self.ids, ids])
        at[fresh] = len(self.ends) + np.arange(len(fresh))
        first, size = (np.cumsum(sizes) - sizes)[at], sizes[at]
        kept = fresh[again[fresh]]
        if len(self.place) + len(kept) > self.most:
            self.clear()
        self.place.update(zip([texts[k] for k in kept], range(len(self.place), len(self.place) + len(kept)), strict=True))
        self.ids = np.concatenate([self.ids, gathered(ids, first[kept], size[kept])])
        self.ends = np.concatenate([self.ends, (self.ends[-1] if len(self.ends) else 0) + np.cumsum(size[kept])])
        return ids, first, size


class WordEncoder:
    """Token ids of whole texts for a tokenizer that splits at white space and drops it.

    The ids of a text are those of its words one after another, so each distinct word of
    a batch is encoded once.  Words that Arrow lowers and cuts as the tokenizer does are
    handed to its BPE as distinct pieces, many at a time; all others go through the
    whole tokenizer.
    """

    def __init__(self, path: str, most: int = 100_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.path, self.bpe = path, Tokenizer.from_file(path)
        self.bpe.normalizer, self.bpe.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        names = self.bpe.get_vocab()
        self.last = np.zeros(max(names.values()) + 1, bool)  # tokens that end a piece
        self.last[[k for name, k in names.items() if name.endswith("</w>")]] = True
        self.letters = byte_letters()
        self.pieces, self.others = Remembered(self.code_pieces, most), Remembered(self.code_words, most)

    def code_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lower-cased pieces and their number for each."""
        written = [p if p.isascii() else p.encode().decode("latin-1").translate(self.letters) for p in pieces]
        ids = [np.zeros(0, np.int64)]
        for at in range(0, len(written), 5000):
            joined = " ".join(written[at : at + 5000])
            ids.append(np.array(self.bpe.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int64))
        ids = np.concatenate(ids)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(pieces):
            raise ValueError("the vocabulary does not mark the ends of pieces")
        return ids.astype(np.uint32), np.diff(ends, prepend=0)

    @functools.cached_property
    def whole(self):
        """The tokenizer as it is, read when a word first needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def code_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = [e.ids for at in range(0, len(words), 5000) for e in self.whole.encode_batch_fast(words[at : at + 5000], add_special_tokens=False)]
        return np.array([i for ids in coded for i in ids], np.uint32), np.fromiter(map(len, coded), np.int64, len(coded))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and their number for each text."""
        if pc.any(pc.match_substring_regex(texts, WIDE_BLANKS)).as_py():
            texts = pc.replace_substring_regex(texts, WIDE_BLANKS, " ")
        words, which, n = distinct_words(texts)
        odd = pc.match_substring_regex(words, UNLIKE)
        unlike = odd.to_numpy(zero_copy_only=False)
        low = pc.utf8_lower(words.filter(pc.invert(odd)))
        cut = pc.match_substring_regex(low, NOT_LETTERS)
        low = pc.replace_with_mask(low, cut, pc.replace_substring_regex(low.filter(cut), PIECE, r"\0 "))
        pieces, piece, n_pieces = distinct_words(low)
        often = np.bincount(which, minlength=len(words))
        again = np.bincount(piece, np.repeat(often[~unlike], n_pieces), len(pieces)) > 1
        ids, first, size = self.pieces(pieces.to_pylist(), again)
        sizes = np.zeros(len(words), np.int64)
        sizes[~unlike] = np.add.reduceat(size[piece], np.cumsum(n_pieces) - n_pieces) if len(piece) else 0
        ids = gathered(ids, first[piece], size[piece])
        firsts = np.cumsum(sizes) - sizes
        if unlike.any():
            own, first, size = self.others(words.filter(odd).to_pylist(), often[unlike] > 1)
            firsts[unlike], sizes[unlike] = len(ids) + first, size
            ids = np.concatenate([ids, own])
        size = sizes[which]
        sums, ends = np.concatenate([[0], np.cumsum(size)]), np.cumsum(n)
        return gathered(ids, firsts[which], size), sums[ends] - sums[ends - n]


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder for each worker process."""
    return WordEncoder(path)
