"""Edit-aware token counts.

A document's count is the root of a segment tree whose leaves are its pre-tokens, each with the white space after it;
a leaf has its characters and its tokens. An edit finds, by the character sums, the leaves around it: from that of the third
character before it (a pre-token's end depends on up to two characters that follow) to that of the character after it, and on
until a pre-token of the new text ends where one of the old text did. Only these leaves' text, edited, is encoded again, and the
sums above them are updated. Everything else keeps its counts. A leaf is as long as its pre-token: a run of letters with no other
character in it is one, as is what lies between digits in a word with characters outside the Latin ranges.

:func:`keep` writes the leaves down beside each text, and :func:`apply_edits` takes and gives such a table: trees are rebuilt from the kept
counts, and only what edits touch is encoded. :func:`recount` does both at once for one round of edits.

Null text: empty. Null edits, or a null among them: none. Edits apply in order, each to the text that the ones before have left; a range beyond the
end of the text stops there. Equal rows get equal results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import text_or_empty
from cohortry.llm.tokens import VOCABULARY, WordIds, slices, word_ids
from cohortry.session import ship_code


def word_starts(text: str) -> np.ndarray:
    """Where the runs of characters that are not ASCII white space begin."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    solid = ~((points == 32) | ((points >= 9) & (points <= 13)))
    return np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]])) if len(points) else np.zeros(0, np.int64)


_WORDS = re.compile("[^\x20\t-\r]+")


class CountTree:
    """Token counts of one text under edits. ``leaves``: (place in its word, length, tokens) of each pre-token, in order."""

    def __init__(self, text: str, leaves: np.ndarray, encoder: WordIds):
        self.encoder, self.encoded = encoder, 0
        begins, firsts = word_starts(text), np.flatnonzero(leaves[:, 0] == 0)
        if len(begins) != len(firsts):
            raise ValueError("leaves of other words")
        per_word = np.diff(np.append(firsts, len(leaves)))
        inside = np.cumsum(leaves[:, 1]) - leaves[:, 1]
        starts = np.repeat(begins, per_word) + inside - np.repeat(inside[firsts], per_word)
        self._build(text, np.concatenate([[0], starts[1:], [len(text)]]), leaves[:, 2])

    @classmethod
    def kept(cls, text: str, lengths: np.ndarray, tokens: np.ndarray, encoder: WordIds) -> CountTree:
        """The tree of leaves that were written down; nothing is encoded."""
        tree = cls.__new__(cls)
        tree.encoder, tree.encoded = encoder, 0
        tree._build(text, np.concatenate([[0], np.cumsum(lengths)]), tokens)
        return tree

    def leaves(self) -> tuple[str, np.ndarray, np.ndarray]:
        """The text as it is now, and the length and tokens of each leaf."""
        chars, tokens = self.chars[self.width :], self.tokens[self.width :]
        some = chars > 0
        return "".join(self._text(i) for i in np.flatnonzero(some)), chars[some], tokens[some]

    def _build(self, text: str, edges: np.ndarray, tokens: np.ndarray) -> None:
        self.text, self.edges, self.changed = text, edges, {}
        leaves = max(1, len(edges) - 1)
        self.width = 1 << (leaves - 1).bit_length()
        self.tokens, self.chars = np.zeros(2 * self.width, np.int64), np.zeros(2 * self.width, np.int64)
        self.tokens[self.width : self.width + len(tokens)] = tokens
        self.chars[self.width : self.width + len(edges) - 1] = np.diff(edges)
        level = self.width
        while level > 1:
            for sums in (self.tokens, self.chars):
                sums[level // 2 : level] = sums[level : 2 * level].reshape(-1, 2).sum(axis=1)
            level //= 2

    @property
    def count(self) -> int:
        return int(self.tokens[1])

    @property
    def length(self) -> int:
        return int(self.chars[1])

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at``, and where it begins."""
        node, begin = 1, 0
        while node < self.width:
            node *= 2
            if at - begin >= self.chars[node]:
                begin += int(self.chars[node])
                node += 1
        return node - self.width, begin

    def _text(self, leaf: int) -> str:
        return self.changed[leaf] if leaf in self.changed else self.text[self.edges[leaf] : self.edges[leaf + 1]] if leaf < len(self.edges) - 1 else ""

    def _encode(self, text: str) -> list[tuple[int, int]]:
        """Length, with the white space around it, and tokens of each pre-token of a text."""
        starts, counts = [], []
        for word in _WORDS.finditer(text):
            at = word.start()
            for n, count in self.encoder.leaves(word[0]):
                starts.append(at)
                counts.append(count)
                at += n
        if not starts:
            return [(len(text), 0)]
        edges = [0, *starts[1:], len(text)]
        return [(b - a, c) for a, b, c in zip(edges, edges[1:], counts, strict=False)]

    def edit(self, start: int, removed: int, inserted: str) -> None:
        start = min(max(start, 0), self.length)
        removed = min(max(removed, 0), self.length - start)
        first = last = begin = 0
        if self.length:
            first, begin = self._leaf(max(start - 3, 0))
            last, _ = self._leaf(min(start + removed, self.length - 1))
        more = 1
        while True:
            region = "".join(map(self._text, range(first, last + 1)))
            new = region[: start - begin] + inserted + region[start - begin + removed :]
            after, at = "", last + 1
            while at < self.width and len(after) < 3:  # what decides whether a pre-token ends here
                after, at = after + self._text(at), at + 1
            found = self._encode(new + after)
            self.encoded += len(new) + len(after)
            ends = np.cumsum([n for n, _ in found])
            cut = int(np.searchsorted(ends, len(new)))
            if not after or ends[cut] == len(new):
                break
            last, more = min(last + more, self.width - 1), 2 * more
        found = found[: cut + 1]
        a, b = first + self.width, last + self.width
        share = -(-len(found) // (last + 1 - first))  # new leaves to each old one
        self.tokens[a : b + 1], self.chars[a : b + 1] = 0, 0
        self.changed.update(dict.fromkeys(range(first, last + 1), ""))
        at = 0
        for k in range(0, len(found), share):
            part = found[k : k + share]
            leaf, n = first + k // share, sum(n for n, _ in part)
            self.changed[leaf], self.chars[leaf + self.width], self.tokens[leaf + self.width] = new[at : at + n], n, sum(c for _, c in part)
            at += n
        while a > 1:
            a, b = a // 2, b // 2
            for sums in (self.tokens, self.chars):
                sums[a : b + 1] = sums[2 * a : 2 * b + 2].reshape(-1, 2).sum(axis=1)
        if share > 16:
            self._spread(first, last, found)

    def _spread(self, first: int, last: int, found: list[tuple[int, int]]) -> None:
        """The tree anew, with a leaf for each of ``found`` in place of those from ``first`` to ``last``; nothing is encoded."""
        chars, tokens = self.chars[self.width :], self.tokens[self.width :]
        texts = "".join(map(self._text, range(self.width)))
        n, t = zip(*found, strict=True)
        lengths, counts = (np.concatenate([old[:first], new, old[last + 1 :]]) for old, new in ((chars, n), (tokens, t)))
        kept = lengths > 0
        self._build(texts, np.concatenate([[0], np.cumsum(lengths[kept])]), counts[kept])


def _edited(tree: CountTree, changes: list[dict | None] | None) -> int:
    """Applies edits, and says how many there were."""
    made = [c for c in changes or () if c]
    for change in made:
        tree.edit(change["start"] or 0, change["removed"] or 0, change["inserted"] or "")
    return len(made)


KEPT = "text string, lengths array<int>, tokens array<int>"


def keep(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, text, and the length and tokens of each leaf: the trees of all texts, as a table to be written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, ints = word_ids(vocabulary), pa.list_(pa.int32())
        for batch in batches:
            for part in slices(batch, 1):
                found = [CountTree(text, leaves, encoder).leaves() for leaves, text in zip(encoder.all_leaves(part.column(1)), part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array([f[i].tolist() for f in found], ints) for i in (1, 2)]], names=["doc_id", "text", "lengths", "tokens"])

    ship_code(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs).alias("text")).mapInArrow(run, f"doc_id long, {KEPT}")


def apply_edits(kept: DataFrame, edits: Column, vocabulary: str = VOCABULARY) -> DataFrame:
    """The table of :func:`keep` after ``edits``, with n_tokens, n_edits, edited_n_tokens and encoded_chars (0 for a text without edits)."""
    counts = ["n_tokens", "n_edits", "edited_n_tokens", "encoded_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, ints = word_ids(vocabulary), pa.list_(pa.int32())
        for batch in batches:
            for part in slices(batch, 1):
                texts, trees, out = part.column(1).to_pylist(), [], []
                for text, lengths, tokens, changes in zip(texts, *(c.to_pylist() for c in part.columns[2:]), strict=True):
                    tree = CountTree.kept(text or "", np.array(lengths or [], np.int64), np.array(tokens or [], np.int64), encoder)
                    before = tree.count
                    out.append((before, _edited(tree, changes), tree.count, tree.encoded))
                    trees.append(tree.leaves())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t[0] for t in trees], pa.string()), *[pa.array([t[i].tolist() for t in trees], ints) for i in (1, 2)], *[pa.array(x, pa.int64()) for x in zip(*out, strict=True)]], names=["doc_id", "text", "lengths", "tokens", *counts])

    ship_code(kept.sparkSession)
    rows = kept.select("doc_id", "text", "lengths", "tokens", edits.alias("edits"))
    return rows.mapInArrow(run, f"doc_id long, {KEPT}, " + ", ".join(f"{c} long" for c in counts))


def recount(docs: DataFrame, edits: Column, vocabulary: str = VOCABULARY) -> DataFrame:
    """``edits``: an array of (start, removed, inserted) in code points, per row of ``docs``.

    Gives doc_id, n_tokens, n_edits, edited_n_chars, edited_n_tokens and encoded_chars, the characters encoded again.
    """
    names = ["doc_id", "n_tokens", "n_edits", "edited_n_chars", "edited_n_tokens", "encoded_chars"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(vocabulary)
        for batch in batches:
            for part in slices(batch, 1):
                out = []
                for leaves, doc, text, changes in zip(encoder.all_leaves(part.column(1)), *(c.to_pylist() for c in part.columns), strict=True):
                    tree = CountTree(text, leaves, encoder)
                    before = tree.count
                    out.append((doc, before, _edited(tree, changes), tree.length, tree.count, tree.encoded))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=names)

    ship_code(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs).alias("text"), edits.alias("edits"))
    return rows.mapInArrow(count, ", ".join(f"{n} long" for n in names))


def sample_edits(text: Column) -> Column:
    """Three edits to any text: cut a fiftieth out at a third, put its first 40 characters in at the half, replace its last 7."""
    n = F.length(text)
    edit = lambda start, removed, inserted: F.struct(start.cast("long").alias("start"), removed.cast("long").alias("removed"), inserted.alias("inserted"))
    third, cut = F.floor(n / 3), F.floor(n / 50)
    left = n - cut
    put = F.substr(text, F.lit(1), F.lit(40))
    end = left + F.length(put)
    tail = F.least(F.lit(7), end)
    return F.array(edit(third, cut, F.lit("")), edit(F.floor(left / 2), F.lit(0), put), edit(end - tail, tail, F.lit(" the end.")))
