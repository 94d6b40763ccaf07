"""Language-model scores by a hierarchical Pitman-Yor model over words and the words before them.

Each word is a context with a restaurant of its own; all of them share one parent restaurant, whose customers are their tables and whose
base is uniform over the known words and one unknown. Seating is sampled by Gibbs steps (``seating``), in rounds: all context
restaurants in parallel, given the parent's probabilities and their table totals of the round before; then the parent, given
their tables (its own seating starts anew each round, as its customers change). Predictive probabilities are averaged over the rounds
after the first. Pairs seen once have one table whatever is drawn, so only the others are seated.

Work is shared out by numpy blocks that Spark shuffles. Texts are read once, in slices of bounded bytes, which keep word codes. A slice
sends the distinct pairs it holds, with their training counts, to buckets chosen by the context, and for contexts with a
thousandth of the training words or more (a thousand at most) by the word too. A bucket adds them up and seats them; what a
pair's count and tables come to goes back to the slices in the order in which they asked. Per-word figures travel as rows, by joins on
the word's id; at the end slices ask for them as they ask for pairs, from parts that hold them packed. Only totals and the frequent
contexts reach the driver; a slice meets a word's figures only if it holds the word.

Words are known by 64 of the 128 bits of a hash; if two share them, 32 of the others show it and all is done again with another seed.
Null text: empty, scored by its end alone. Null doc_id: a training document. Rows that repeat are documents of their own. A text
longer than a slice is a slice. Without training documents every score is that of the uniform base.
"""

from __future__ import annotations

import ctypes
import math
import struct
from collections.abc import Iterator
from functools import cache, reduce
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import Staged, free_shuffles, stage, text_or_empty
from cohortry.llm.seating import mixed, tables_of_few, tables_of_many
from cohortry.llm.tokens import slices
from cohortry.session import ship_code

#: Dishes of up to so many customers have their tables drawn at once.
FEW = 16
#: No words: what ends a text (an empty word) and what stands before it (a blank).
END, START = b"", b" "
SLICED = "slice long, tokens long, doc_ids array<long>, held array<boolean>, ends array<int>, codes binary, words binary"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


@cache
def _zstd():
    """This worker's compressor and decompressor."""
    from zstandard import ZstdCompressor, ZstdDecompressor

    return ZstdCompressor(level=1), ZstdDecompressor()


def pack(*arrays: np.ndarray) -> bytes:
    """Compressed, byte by byte of all numbers: high bytes are mostly zero."""

    def one(a: np.ndarray) -> bytes:
        z = _zstd()[0].compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes())
        return struct.pack("<2sq", a.dtype.str[1:].encode(), len(z)) + z

    return b"".join(map(one, arrays))


def unpack(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        kind, size = struct.unpack_from("<2sq", blob, at)
        at += 10
        dtype = np.dtype("<" + kind.decode())
        out.append(np.ascontiguousarray(np.frombuffer(_zstd()[1].decompress(blob[at : at + size]), np.uint8).reshape(dtype.itemsize, -1).T).view(dtype).ravel())
        at += size
    return out


def _frugal() -> None:
    """Lets this worker give memory back when it is freed, as the next stage's arrays come from elsewhere: Arrow's, and arrays of 512 KB or
    more (glibc keeps ever larger ones for itself unless told their size)."""
    pa.set_memory_pool(pa.system_memory_pool())
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.mallopt(-3, 512 << 10)  # M_MMAP_THRESHOLD
        libc.malloc_trim(0)


def word_keys(words: list[bytes], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Id and check (32 bits) of each word."""
    from xxhash import xxh3_128_digest

    both = np.frombuffer(b"".join([xxh3_128_digest(w, seed) for w in words]), "<i8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].astype(np.int32)


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Codes of all words with an end after each text's, where each text ends, and the words by code, frequent ones first; the last is the end."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pa.concat_arrays([texts])))  # a copy: ascii_lower misreads arrays cast from a slice
    coded = split.flatten().dictionary_encode()
    words, which, offsets = coded.dictionary.cast(pa.large_binary()).to_pylist(), coded.indices.to_numpy(zero_copy_only=False), split.offsets.to_numpy()
    if b"" in words:
        solid = which != words.index(b"")
        which, offsets = which[solid], np.concatenate([[0], np.cumsum(solid)])[offsets]
    often = np.bincount(which, minlength=len(words))
    order = np.argsort(-often, kind="stable")
    order = order[often[order] > 0]
    place = np.zeros(len(words), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    ends = np.diff(offsets).cumsum() + np.arange(1, len(offsets))
    codes = np.full(len(which) + len(offsets) - 1, len(order), np.int32)
    is_word = np.ones(len(codes), bool)
    is_word[ends - 1] = False
    codes[is_word] = place[which]
    return codes, ends, [words[i] for i in order] + [END]


def sliced(docs: DataFrame, seed: int, most_bytes: int) -> DataFrame:
    """The corpus as slices: codes of all tokens, and per code the word's id, check and training count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _frugal()
        number = count(TaskContext.get().partitionId() << 24)
        for batch in batches:
            for part in slices(batch, 2, most_bytes):
                codes, ends, words = _coded(part.column(2))
                held = part.column(1).to_numpy(zero_copy_only=False)
                ids, check = word_keys([*words, START], seed)
                training = np.repeat(~held, np.diff(ends, prepend=0))
                known = pack(ids, check, np.bincount(codes[training], minlength=len(ids)))
                yield pa.RecordBatch.from_arrays([pa.array([next(number)], pa.int64()), pa.array([len(codes)], pa.int64()), pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([held.tolist()], pa.list_(pa.bool_())), pa.array([ends.tolist()], pa.list_(pa.int32())), pa.array([pack(codes)], pa.binary()), pa.array([known], pa.binary())], names=[c.split()[0] for c in SLICED.split(", ")])

    ship_code(docs.sparkSession)
    number = docs["doc_id"].cast("string")
    held = F.crc32(F.coalesce(number, F.lit("")).cast("binary")) % 5 == 1
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), held.alias("held"), text_or_empty(docs).alias("text")).mapInArrow(run, SLICED)


def _rows(df: DataFrame, column: str, keys: list[str], made: str) -> DataFrame:
    """A row for each entry of the arrays that ``column`` packs (the first ones, as many as ``made`` names), beside ``keys``."""
    names = [c.split()[0] for c in made.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _frugal()
        for batch in batches:
            for row in batch.to_pylist():
                arrays = unpack(row[column])[: len(names)]
                yield pa.RecordBatch.from_arrays([*[pa.array(np.full(len(arrays[0]), row[k])) for k in keys], *map(pa.array, arrays)], names=[*keys, *names])

    ship_code(df.sparkSession)
    return df.filter(F.col(column).isNotNull()).select(*keys, column).mapInArrow(run, ", ".join([*[f"{k} long" for k in keys], made]))


def _added(df: DataFrame, column: str, made: dict[str, tuple[int, np.ufunc]], at_once: int = 6) -> DataFrame:
    """A row for each id (the first array that ``column`` packs) of some rows: per name, what the ufunc makes of the array of that number. Partial: ids meet again in a grouping."""

    def flushed(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        ids = np.concatenate([p[0] for p in parts])
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.empty(0, np.int64)
        columns = [f.reduceat(np.concatenate([p[i] for p in parts])[order], first).astype(np.int64) if len(first) else first for i, f in made.values()]
        return pa.RecordBatch.from_arrays([pa.array(ids[first]), *map(pa.array, columns)], names=["id", *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _frugal()
        waiting = []
        for batch in batches:
            for blob in batch.column(0):
                waiting.append(unpack(blob.as_py()))
                if len(waiting) == at_once:
                    yield flushed(waiting)
                    waiting = []
        if waiting:
            yield flushed(waiting)

    ship_code(df.sparkSession)
    return df.filter(F.col(column).isNotNull()).select(column).mapInArrow(run, ", ".join(["id long", *[f"{n} long" for n in made]]))


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values of non-negative ``key``, ascending, where each first stands among the sorted ones, and which of them each entry is."""
    place_bits, inverse = len(key).bit_length(), np.empty(len(key), np.int32)
    if len(key) and int(key.max()).bit_length() + place_bits < 64:  # value and place in one number: sorting is faster than its order
        both = np.sort(key << place_bits | np.arange(len(key)))
        place = both & ((1 << place_bits) - 1)
        both >>= place_bits
    else:
        place = np.argsort(key, kind="stable")
        both = key[place]
    new = np.ones(len(key), bool)
    new[1:] = both[1:] != both[:-1]
    inverse[place] = np.cumsum(new, dtype=np.int32) - 1
    first = np.flatnonzero(new)
    return both[first], first, inverse


def _dealt(part: np.ndarray, parts: int) -> np.ndarray:
    """The order by part, which is a number below ``parts``, then place."""
    return np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")


class Pairs:
    """The distinct pairs (word before, word) of a slice, in the order in which their buckets are asked."""

    def __init__(self, codes: np.ndarray, ids: np.ndarray, ends: np.ndarray, frequent: np.ndarray, buckets: int):
        self.ids = ids
        key = np.empty(len(codes), np.int64)
        key[1:] = codes[:-1]
        key[np.concatenate([[0], ends[:-1]])] = len(ids) - 1
        key *= len(ids)
        key += codes
        found, _, inverse = _distinct(key)
        del key
        self.u, self.w = (found // len(ids)).astype(np.int32), (found % len(ids)).astype(np.int32)
        del found
        often = np.isin(self.ids, frequent)[self.u]
        spread = mixed(self.ids)[self.u] + np.where(often, mixed(self.ids, 1)[self.w], np.uint64(0))
        bucket = (mixed(spread) % np.uint64(buckets)).astype(np.int64)
        del often, spread
        order = _dealt(bucket, buckets).astype(np.int32)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.u, self.w, self.bucket, self.of_token = self.u[order], self.w[order], bucket[order], place[inverse]


def _listed(ids: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the codes in use, and each code's place among them: ids do not pack, places do."""
    used, _, place = _distinct(codes.astype(np.int64))
    return ids[used], place


def asked(corpus: DataFrame, frequent: np.ndarray, buckets: int) -> DataFrame:
    """slice, bucket, blob: the pairs (ids) of a slice that fall to a bucket, with their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _frugal()
        for batch in batches:
            for row in batch.to_pylist():
                codes, ids, ends = unpack(row["codes"])[0], unpack(row["words"])[0], np.array(row["ends"])
                pairs = Pairs(codes, ids, ends, frequent, buckets)
                training = np.repeat(~np.array(row["held"]), np.diff(ends, prepend=0))
                n = np.bincount(pairs.of_token[training], minlength=len(pairs.u)).astype(np.int32)
                cut = np.concatenate([[0], np.flatnonzero(np.diff(pairs.bucket)) + 1, [len(n)]])
                blobs = [pack(*_listed(pairs.ids, pairs.u[a:b]), *_listed(pairs.ids, pairs.w[a:b]), n[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array([row["slice"]] * len(blobs), pa.int64()), pa.array(pairs.bucket[cut[:-1]]), pa.array(blobs, pa.binary())], names=["slice", "bucket", "blob"])

    return corpus.select("slice", "held", "ends", "codes", "words").mapInArrow(run, "slice long, bucket long, blob binary")


def _bucket(table: pa.Table) -> pa.Table:
    """A bucket's pairs added up. Rows of a slice: which pair each of its requests is (0: untrained, 1: seen once, else 2 and its place
    in the state). One row more: the state (places of context and word in ``ids``, customers, tables, and their sum over samples), the ids,
    and per-word counts."""
    _frugal()
    table = table.sort_by("slice")
    parts = [unpack(b) for b in table.column("blob").to_pylist()]
    cuts, n = np.cumsum([len(p[4]) for p in parts])[:-1], np.concatenate([p[4] for p in parts])

    def placed(i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of one side, ascending, and the place among them of each request's."""
        ids, inverse = np.unique(np.concatenate([p[i] for p in parts]), return_inverse=True)
        begin = np.cumsum([0, *[len(p[i]) for p in parts]])
        return ids, np.concatenate([inverse[begin[k] : begin[k + 1]][p[i + 1]] for k, p in enumerate(parts)])

    (all_u, u), (all_w, w) = placed(0), placed(2)
    del parts
    key = u * len(all_w)
    key += w
    del u, w
    found, first, inverse = _distinct(key)
    del key
    gu, gw = found // len(all_w), found % len(all_w)
    c = np.bincount(inverse, n, len(found)).astype(np.int64)
    more = c > 1
    which = np.where(more, np.cumsum(more) + 1, c).astype(np.int32)[inverse]
    del found, first, inverse, n
    u1, w1, u2, w2 = (np.bincount(x[mask], minlength=len(ids)) for mask in (c == 1, more) for x, ids in ((gu, all_u), (gw, all_w)))
    ids = np.union1d(all_u[u2 > 0], all_w[w2 > 0])
    at_u, at_w, c2 = np.searchsorted(ids, all_u).astype(np.int32)[gu[more]], np.searchsorted(ids, all_w).astype(np.int32)[gw[more]], c[more]
    state = pack(at_u, at_w, c2, np.ones(len(c2), np.int64), np.zeros(len(c2), np.int64))
    seen = np.union1d(all_u[u1 + u2 > 0], all_w[w1 + w2 > 0])

    def spread(counts: np.ndarray, own: np.ndarray) -> np.ndarray:
        out, used = np.zeros(len(seen), np.int64), counts > 0
        out[np.searchsorted(seen, own[used])] = counts[used]
        return out

    words = pack(seen, spread(u1, all_u), spread(w1, all_w), spread(u2, all_u), spread(w2, all_w))
    rows, key = table.num_rows, table.column("bucket")[0].as_py()
    none = [None] * rows
    return pa.table({
        "bucket": pa.array([key] * (rows + 1), pa.int64()), "slice": pa.array([*table.column("slice").to_pylist(), None], pa.int64()), "which": pa.array([*[pack(x) for x in np.split(which, cuts)], None], pa.binary()),
        "state": pa.array([*none, state], pa.binary()), "ids": pa.array([*none, pack(ids)], pa.binary()), "words": pa.array([*none, words], pa.binary()),
        "once": pa.array([*none, int((c == 1).sum())], pa.int64()), "twice": pa.array([*none, int((c == 2).sum())], pa.int64()),
    })


def _discount(once: int, twice: int) -> float:
    """As estimated from how many things were seen once and twice; within bounds that keep the seating proper."""
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


def seated_anew(customers: np.ndarray, tables: np.ndarray, keys: np.ndarray, restaurant: np.ndarray, parent: np.ndarray, strength: float, discount: float, salt: int) -> np.ndarray:
    """The next number of tables of dishes with two customers or more: each drawn given the others', all customers anew."""
    few = customers <= FEW
    out, many = np.empty(len(customers), np.int64), np.flatnonzero(~few)
    out[few] = tables_of_few(customers[few], tables[few], keys[few], restaurant[few], parent[few], strength, discount, salt, FEW)
    out[many] = tables_of_many(customers[many], tables[many], keys[many], restaurant[many], parent[many], strength, discount, salt)
    return out


def _parent(words: DataFrame, known: int, strength: float, discount: float, tables: int, salt: int) -> DataFrame:
    """Adds ``t``, the parent's tables of each word with ``m`` customers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, m = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            t, more = np.minimum(m, 1), np.flatnonzero(m > 1)
            if len(more):
                t = t.copy()
                t[more] = seated_anew(m[more], np.ones(len(more), np.int64), ids[more], np.full(len(more), tables), np.full(len(more), 1 / (known + 1)), strength, discount, salt)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(t, pa.int64())], names=[*batch.schema.names, "t"])

    return words.select("id", "m", "tables").mapInArrow(run, "id long, m long, tables long, t long")


def _seat(strength: float, discount: float, salt: int, counted: bool):
    """A round of a bucket: its state and the figures (id, parent, tables) of its words give the next state and its tables per word."""

    def run(states: pa.Table, facts: pa.Table) -> pa.Table:
        if not states.num_rows:
            return pa.table({"bucket": pa.array([], pa.int64()), "state": pa.array([], pa.binary()), "words": pa.array([], pa.binary())})
        _frugal()
        at_u, at_w, c, tables, added = unpack(states.column("state")[0].as_py())
        facts = facts.sort_by("id")
        ids, parent, totals = (facts.column(x).to_numpy() for x in ("id", "parent", "tables"))
        tables = seated_anew(c, tables, mixed(ids)[at_u] + mixed(ids, 1)[at_w], totals[at_u], parent[at_w], strength, discount, salt)
        per = lambda x: np.bincount(x, tables, len(ids)).astype(np.int64)
        state = pack(at_u, at_w, c, tables, added + tables * counted)
        return pa.table({"bucket": states.column("bucket"), "state": pa.array([state], pa.binary()), "words": pa.array([pack(ids, per(at_u), per(at_w))], pa.binary())})

    return run


def _answers(discount: float, samples: int):
    """What each request of a slice comes to: customers less the discount of their tables, averaged."""

    def run(requests: pa.Table, states: pa.Table) -> pa.Table:
        _frugal()
        _, _, c, _, added, *_ = unpack(states.column("state")[0].as_py())
        worth = np.concatenate([[0.0, 1 - discount], c - discount * added / samples]).astype(np.float32)
        found = [pack(worth[unpack(b)[0]]) for b in requests.column("which").to_pylist()]
        return pa.table({"slice": requests.column("slice"), "bucket": requests.column("bucket"), "blob": pa.array(found, pa.binary())})

    return run


def _wanted(corpus: DataFrame, parts: int) -> DataFrame:
    """slice, part, blob: the ids of a slice's words that fall to a part (by remainder), in the order of their codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _frugal()
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["words"])[0]
                part = ids % parts
                order = _dealt(part, parts)
                cut = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1))
                blobs = [pack(ids[order[a:b]]) for a, b in zip(cut, cut[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array([row["slice"]] * len(blobs), pa.int64()), pa.array(part[order[cut[:-1]]]), pa.array(blobs, pa.binary())], names=["slice", "part", "blob"])

    return corpus.select("slice", "words").mapInArrow(run, "slice long, part long, blob binary")


def _packed(columns: list[str]):
    """The figures of a part's words in one blob, by id."""

    def run(facts: pa.Table) -> pa.Table:
        _frugal()
        facts = facts.sort_by("id")
        return pa.table({"part": facts.column("part")[:1], "blob": pa.array([pack(*[facts.column(c).to_numpy() for c in ("id", *columns)])], pa.binary())})

    return run


def _looked_up(requests: pa.Table, facts: pa.Table) -> pa.Table:
    """The figures of the words that each slice wants from a part."""
    if not requests.num_rows:
        return pa.table({"slice": pa.array([], pa.int64()), "part": pa.array([], pa.int64()), "blob": pa.array([], pa.binary())})
    _frugal()
    ids, *figures = unpack(facts.column("blob")[0].as_py())
    places = [np.searchsorted(ids, unpack(b)[0]) for b in requests.column("blob").to_pylist()]
    return pa.table({"slice": requests.column("slice"), "part": requests.column("part"), "blob": pa.array([pack(*[x[at] for x in figures]) for at in places], pa.binary())})


def _scored(frequent: np.ndarray, buckets: int, columns: list[str], samples: int, training: int, known: int):
    """Scores of a slice's documents, from its codes, the buckets' answers and its words' figures (``columns``, from as many parts as there are buckets)."""

    def run(parts: pa.Table) -> pa.Table:
        _frugal()
        rows = parts.to_pylist()
        own = next(r for r in rows if r["doc_ids"] is not None)
        codes, ids, ends = unpack(own["codes"])[0], unpack(own["words"])[0], np.array(own["ends"])
        answers = lambda kind: [unpack(r["codes"]) for r in sorted((r for r in rows if r[kind] is not None), key=lambda r: r[kind])]
        order, facts = _dealt(ids % buckets, buckets), {}
        for name, found in zip(columns, zip(*answers("part"), strict=True), strict=True):
            facts[name] = np.empty(len(ids))
            facts[name][order] = np.concatenate(found)
        worth = np.concatenate([x[0] for x in answers("bucket")]).astype(float)
        del rows
        pairs = Pairs(codes, ids, ends, frequent, buckets)
        p = worth * facts["scale"][pairs.u]
        del worth
        for s in range(samples):
            p += facts[f"g{s}"][pairs.u] * facts[f"p{s}"][pairs.w] / samples
        counts = facts["n"]
        doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        base = np.log10((counts + 0.5) / (training + 0.5 * (known + 1)))
        total = lambda x: np.bincount(doc, x, len(ends))
        return pa.table({
            "doc_id": pa.array(own["doc_ids"], pa.int64()), "held_out": pa.array(own["held"]), "n_tokens": pa.array(np.diff(ends, prepend=0).astype(np.int64)), "n_known": pa.array(total(counts[codes] > 0).astype(np.int64)),
            "base_score": pa.array(total(base[codes])), "score": pa.array(total(np.log10(p)[pairs.of_token])),
        })

    return run


class Model:
    """The fitted model: ``corpus`` (slices), ``state`` and ``requests`` by bucket, ``figures`` by word; and its totals."""

    def __init__(self, docs: DataFrame, samples: int = 2, burn_in: int = 1, strength: float = 1.0, most_bytes: int = 8 << 20, tokens_per_bucket: int = 1_600_000, turns: int = 4):
        ship_code(docs.sparkSession)
        for seed in count():
            corpus = Staged(sliced(docs, seed, most_bytes), "lm-slices")
            entries = _added(corpus.df, "words", {"n": (2, np.add), "low": (1, np.minimum), "high": (1, np.maximum)})
            vocabulary = Staged(entries.groupBy("id").agg(F.sum("n").alias("n"), (F.min("low") != F.max("high")).alias("_shared")), "lm-vocabulary")
            seen = vocabulary.df
            told = seen.agg(F.sum("n"), F.count_if(F.col("n") > 0), F.count_if("_shared")).first()
            if not told[2]:
                break
            corpus.drop()
            vocabulary.drop()
        self.corpus, self.samples, self.strength, self.turns = corpus.df, samples, strength, turns
        self.training, self.known = told[0] or 0, told[1] or 0
        often = seen.filter((F.col("n") > 0) & (F.col("n") * 1_000 >= self.training)).select("id").collect()  # 1,000 at most
        ends = int(word_keys([END], seed)[0][0])
        texts = seen.filter(F.col("id") == ends).select("n").collect()
        self.frequent = np.array([r["id"] for r in often] + [int(word_keys([START], seed)[0][0])], np.int64)
        tokens = corpus.df.agg(F.sum("tokens")).first()[0] or 0
        self.buckets = max(4, math.ceil(tokens / tokens_per_bucket))
        free_shuffles(docs.sparkSession)
        made = asked(corpus.df, self.frequent, self.buckets).groupBy("bucket").applyInArrow(_bucket, "bucket long, slice long, which binary, state binary, ids binary, words binary, once long, twice long")
        self._buckets = Staged(made, "lm-buckets")
        self.requests = self._buckets.df
        del made, entries
        free_shuffles(docs.sparkSession)
        sums = self.requests.agg(F.sum("once"), F.sum("twice")).first()
        self.discount = _discount(sums[0] or 0, sums[1] or 0)
        free_shuffles(docs.sparkSession)  # again: a job's last shuffle is held until another job has run
        tallied = _added(self.requests, "words", {c: (i, np.add) for i, c in enumerate(("u1", "w1", "u2", "w2"), 1)}).groupBy("id").agg(*[F.sum(c).alias(c) for c in ("u1", "w1", "u2", "w2")])
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
        before = F.when(F.col("id") == int(self.frequent[-1]), F.lit(texts[0]["n"] if texts else 0)).when(F.col("id") == ends, 0).otherwise(F.coalesce("n", F.lit(0))).cast("long")
        words = seen.select("id", "n").join(tallied, "id", "left").select("id", "n", *[zero(c) for c in ("u1", "w1", "u2", "w2")], before.alias("c"))
        self.words = stage(words, "lm-words")
        vocabulary.drop()
        free_shuffles(docs.sparkSession)
        self._sample(burn_in)

    def _sample(self, burn_in: int) -> None:
        asking = Staged(_rows(self.requests, "ids", ["bucket"], "id long"), "lm-ids")
        ids = asking.df
        once = self.words.agg(F.count_if(F.col("w1") + F.col("w2") == 1), F.count_if(F.col("w1") + F.col("w2") == 2)).first()
        above = _discount(once[0] or 0, once[1] or 0)
        state = Staged(self.requests.filter("state is not null").select("bucket", "state"), "lm-state")
        past: list[Staged] = []
        tables, current, figures = self.known, self.words.select("id", (F.col("w1") + F.col("w2")).alias("m"), (F.col("u1") + F.col("u2")).alias("tables")), None
        for turn in range(burn_in + self.samples + 1):
            seated = Staged(_parent(current, self.known, self.strength, above, tables, 1_000 * turn), "lm-parent")
            parent = seated.df
            sums = parent.agg(F.sum("m"), F.sum("t")).first()
            customers, tables = sums[0] or 0, sums[1] or 0
            chance = (F.col("m") - above * F.col("t") + (self.strength + above * tables) / (self.known + 1)) / (self.strength + customers)
            now = parent.select("id", chance.alias("parent"), "tables")
            if turn > burn_in:
                taken = now.select("id", F.col("parent").alias(f"p{turn - burn_in - 1}"), F.col("tables").alias(f"t{turn - burn_in - 1}"))
                figures = taken if figures is None else figures.join(taken, "id")
                past.append(seated)
            if turn == burn_in + self.samples:
                break
            facts = ids.join(now, "id")
            run = _seat(self.strength, self.discount, 1_000 * turn + 500, turn >= burn_in)
            made = state.df.groupBy("bucket").cogroup(facts.groupBy("bucket")).applyInArrow(run, "bucket long, state binary, words binary")
            before, made = state, Staged(made, "lm-state")
            state = made
            before.drop()
            if turn <= burn_in:
                seated.drop()
            free_shuffles(ids.sparkSession)
            grown = _added(made.df, "words", {"u": (1, np.add), "w": (2, np.add)}).groupBy("id").agg(F.sum("u").alias("u"), F.sum("w").alias("w"))
            some = lambda c: F.coalesce(c, F.lit(0).cast("long"))
            current = self.words.select("id", "w1", "u1").join(grown, "id", "left").select("id", (F.col("w1") + some("w")).alias("m"), (F.col("u1") + some("u")).alias("tables"))
        self._seating = state
        self.state, self.figures = state.df.select("bucket", "state"), stage(figures, "lm-figures")
        for rest in (asking, *past):
            rest.drop()
        free_shuffles(ids.sparkSession)

    def scores(self, keep: bool = True) -> DataFrame:
        """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. The seating is deleted first unless it is to be kept."""
        scale = 1 / (self.strength + F.col("c"))
        drawn = [x for s in range(self.samples) for x in (F.col(f"p{s}").cast("float").alias(f"p{s}"), ((self.strength + self.discount * F.col(f"t{s}")) * scale).cast("float").alias(f"g{s}"))]
        figures = self.words.select("id", "n", "c").join(self.figures, "id").select("id", "n", scale.cast("float").alias("scale"), *drawn)
        answers = self.requests.filter("slice is not null").select("bucket", "slice", "which").groupBy("bucket").cogroup(self.state.groupBy("bucket")).applyInArrow(_answers(self.discount, self.samples), "slice long, bucket long, blob binary")
        answers = stage(answers, "lm-answers")
        if not keep:
            self._buckets.drop()
            self._seating.drop()
        free_shuffles(answers.sparkSession)
        columns = figures.columns[1:]
        packed = stage(figures.withColumn("part", F.pmod("id", F.lit(self.buckets).cast("long"))).groupBy("part").applyInArrow(_packed(columns), "part long, blob binary"), "lm-packed")
        free_shuffles(answers.sparkSession)
        run = _scored(self.frequent, self.buckets, columns, self.samples, self.training, self.known)
        found = []
        for turn in range(self.turns):  # what the slices of a turn shuffle is let go before the next
            mine = F.pmod(F.xxhash64("slice"), F.lit(self.turns)) == turn
            corpus = self.corpus.filter(mine)
            facts = _wanted(corpus, self.buckets).groupBy("part").cogroup(packed.groupBy("part")).applyInArrow(_looked_up, "slice long, part long, blob binary")
            parts = corpus.select("slice", "doc_ids", "held", "ends", "codes", "words")
            for given, kind in ((answers.filter(mine), "bucket"), (facts, "part")):
                parts = parts.unionByName(given.select("slice", kind, F.col("blob").alias("codes")), allowMissingColumns=True)
            found.append(stage(parts.groupBy("slice").applyInArrow(run, RESULT), "lm-scores"))
            del facts, parts, given
            free_shuffles(answers.sparkSession)
        found = reduce(DataFrame.unionAll, found)
        return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(self.training).cast("long").alias("train_tokens"), "base_score", "score")


def score(docs: DataFrame, **settings) -> DataFrame:
    return Model(docs, **settings).scores(keep=False)
