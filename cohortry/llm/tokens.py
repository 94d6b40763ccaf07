"""Token ids through a public tokenizer, with bounded caches, and edit-aware token counts.

The vocabulary file is read on the executors, from its name or path. The word-level vocabulary never joins
pre-tokens across ASCII white space, so ids of a text are the ids of its words in order; each worker keeps the
ids of the words it has met, in two generations of bounded size. Texts are taken in slices of bounded bytes, so that a
worker's memory follows neither the number of rows in a batch nor their lengths (but for one text longer than a slice).
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "word_bpe_49k.json"

_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Words of these characters are split here; any other word goes through the tokenizer's own steps.
_PLAIN = re.compile("[\\x21-\\x7eÀ-įı-ɏ]+")
_BEFORE_DIGIT = re.compile("(?=[0-9])")
_PRE_TOKENS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")


def vocabulary_path(vocabulary: str) -> str:
    if "/" in vocabulary:
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Generations(dict):
    """A dict that computes what it misses; at ``limit`` entries the older half is forgotten."""

    def __init__(self, compute, limit: int):
        super().__init__()
        self.compute, self.limit, self.older = compute, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class WordIds:
    """Ids of whole texts by a word-level vocabulary."""

    def __init__(self, vocabulary: str = VOCABULARY, cached: int = 100_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(vocabulary))
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model, self.table = self.tokenizer.model, _byte_letters()
        self.four = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]
        self.pre_tokens = _Generations(self._merge, cached)

    def _merge(self, pre_token: str) -> bytes:
        shown = pre_token if pre_token.isascii() else pre_token.encode().decode("latin-1").translate(self.table)
        return b"".join([self.four[t.id] for t in self.model.tokenize(shown)])

    def _pieces(self, word: str) -> Iterator[tuple[int, bytes]]:
        """Length in characters and ids of the parts of a text without ASCII white space, cut only where pre-tokens end."""
        if word.isascii() and word.isprintable() or _PLAIN.fullmatch(word):
            lower, known = word.lower(), self.pre_tokens
            for p in [lower] if lower.isalpha() else _PRE_TOKENS.findall(lower):
                yield len(p), known[p] if len(p) <= 64 else self._merge(p)
        else:  # normal forms and other scripts by the tokenizer's own steps; a digit is a pre-token whatever stands around it
            for p in _BEFORE_DIGIT.split(word):
                if p:
                    yield len(p), b"".join([self.four[i] for i in self.tokenizer.encode(p, add_special_tokens=False).ids])

    def word(self, word: str) -> bytes:
        """Ids, as little-endian unsigned 32-bit bytes, of a text without ASCII white space."""
        lower, known = word.lower(), self.pre_tokens
        if len(word) <= 64 and lower.isascii():
            if lower.isalpha():
                return known[lower]
            if lower[:-1].isalpha() and lower.isprintable():
                return known[lower[:-1]] + known[lower[-1]]
        return b"".join([ids for _, ids in self._pieces(word)])

    def leaves(self, word: str) -> list[tuple[int, int]]:
        """Length and number of ids of the parts of a word."""
        return [(n, len(ids) // 4) for n, ids in self._pieces(word)]

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (with the end of the last)."""
        words, which, offsets = self._coded(texts)
        found = [self.word(w) if w else b"" for w in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts, ids = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(found), "<u4")
        ends = np.cumsum(sizes[which])
        flat = ids[np.repeat(starts[which] - ends + sizes[which], sizes[which]) + np.arange(ends[-1] if len(ends) else 0)]
        return flat, np.concatenate([[0], ends])[offsets]

    def _coded(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct words, which of them stand in the texts in order, and where each text's begin."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        which, offsets = coded.indices.to_numpy(zero_copy_only=False), split.offsets.to_numpy()
        if "" in words:  # beside white space at either end of a text
            solid = which != words.index("")
            which, offsets = which[solid], np.concatenate([[0], np.cumsum(solid)])[offsets]
        return words, which, offsets

    def all_leaves(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """For each text its leaves in order: rows of (place in its word, length, number of ids)."""
        words, which, offsets = self._coded(texts)
        made = [self.leaves(w) if w else [] for w in words]
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        starts, ends = np.cumsum(sizes) - sizes, np.cumsum(sizes[which])
        flat = np.array([x for leaves in made for x in leaves], np.int64).reshape(-1, 2)
        place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes[which], sizes[which])
        rows = np.column_stack([place, flat[np.repeat(starts[which], sizes[which]) + place]])
        bounds = np.concatenate([[0], ends])[offsets].tolist()
        for a, b in zip(bounds, bounds[1:], strict=False):
            yield rows[a:b]


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive parts of up to ``most_bytes`` of text in ``column``, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most_bytes, "right")))
        yield batch.slice(at, end - at)
        at = end


_made: dict[str, WordIds] = {}


def word_ids(vocabulary: str) -> WordIds:
    """One per worker process and vocabulary."""
    if vocabulary not in _made:
        _made[vocabulary] = WordIds(vocabulary)
    return _made[vocabulary]
