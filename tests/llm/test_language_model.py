"""The Pitman-Yor model: seating against exact posteriors, scores against plain counts and the fitted tables, and held-out texts."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cohortry.llm import language_model as lm
from cohortry.llm.seating import first_seating, reseat, tables_of_few

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_seating_has_the_exact_distribution_of_tables():
    """For c customers of one dish, P(t) is in proportion to S(c, t) * prod_{j<t}(strength + discount * (others + j)) * parent^t."""
    c, strength, discount, parent, others, n = 5, 1.0, 0.6, 0.3, 2, 20_000
    stirling = {(0, 0): 1.0}
    for i in range(c):
        for t in range(i + 2):
            stirling[i + 1, t] = stirling.get((i, t - 1), 0.0) + (i - discount * t) * stirling.get((i, t), 0.0)
    weight = np.array([stirling[c, t] * math.prod((strength + discount * (others + j)) * parent for j in range(t)) for t in range(1, c + 1)])
    customers, p = np.full(n, c), np.full(n, parent)
    seating = first_seating(customers, np.full(n, 1.0), discount)
    restaurant = others + np.bincount(seating[0], seating[2], n).astype(np.int64)
    dish, size, tables, own = reseat(*seating, np.arange(n), customers, restaurant, p, strength, discount, 40, 7)
    assert np.abs(np.bincount(own, minlength=c + 1)[1:] / n - weight / weight.sum()).max() < 0.015
    assert (np.bincount(dish, size * tables, n) == c).all() and (np.bincount(dish, tables, n) == own).all()
    at_once = tables_of_few(customers, np.ones(n, np.int64), np.arange(n), np.full(n, others + 1), p, strength, discount, 9)
    assert np.abs(np.bincount(at_once, minlength=c + 1)[1:] / n - weight / weight.sum()).max() < 0.015


def test_first_seating_of_many_customers():
    customers = np.array([1, 2, 10, 10**9])
    dish, size, tables = first_seating(customers, np.full(4, 0.5), 0.8)
    assert (np.bincount(dish, size * tables, 4).astype(np.int64) == customers).all() and (tables > 0).all()


def tokens(text):
    return [w.lower() for w in (text or "").encode().split()] + [lm.END]


def made_docs(seed=3, n=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["The", "THE", "ünï", "𝄞"]
    follows = {w: rng.sample(words, 4) for w in words}
    out = []
    for i in range(n):
        now, said = rng.choice(words), []
        for _ in range(rng.choice([0, 1, 5, 40])):
            now = rng.choice(follows[now]) if rng.random() < 0.8 else rng.choice(words)
            said.append(now if rng.random() < 0.98 else f"rare{rng.randrange(10**6)}")
        out.append((i, "\t \n".join(said), "en", "a", 1))
    return out + [(n, None, None, None, None), (n + 1, "  \x0b ", "en", "a", 1), (n + 2, "w1 " * 30_000, "en", "a", 1), (None, "w1 w2", "en", "a", 1), (7, "w3 again", "en", "a", 1), (7, "w3 again", "en", "a", 1)]


@pytest.fixture(scope="module")
def fitted(spark):
    rows = made_docs()
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS slice", "'x' AS held", "2 AS bucket").repartition(3)
    model = lm.Model(docs, most_bytes=4_000, tokens_per_bucket=500)
    return rows, model, model.scores().collect()


def held_out(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def test_base_columns_are_plain_counts(fitted):
    rows, _, got = fitted
    counts = Counter(t for i, text, *_ in rows if not held_out(i) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), held_out(i), len(tokens(text)), sum(counts[t] > 0 for t in tokens(text)), n, round(sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(text)), 6)) for i, text, *_ in rows)
    assert sorted((str(r[0]), *r[1:5], round(r["base_score"], 6)) for r in got) == want


def test_scores_are_those_of_the_seating(fitted):
    rows, model, got = fitted
    name = {int(lm.word_keys([w], 0)[0][0]): w for _, text, *_ in rows for w in [*tokens(text), lm.START]}
    pairs = Counter(p for i, text, *_ in rows if not held_out(i) for p in zip([lm.START, *tokens(text)], tokens(text), strict=False))
    contexts = Counter()
    for (u, _), c in pairs.items():
        contexts[u] += c
    figures = {name[r["id"]]: r for r in model.figures.collect()}
    seated = {}
    for state, ids in ((lm.unpack(r["state"]), lm.unpack(r["ids"])[0]) for r in model.state.join(model.requests.filter("ids is not null").select("bucket", "ids"), "bucket").collect()):
        for u, w, c, added in zip(state[0], state[1], state[2], state[4], strict=True):
            seated[name[int(ids[u])], name[int(ids[w])]] = (int(c), int(added))
    assert {p: c for p, (c, _) in seated.items()} == {p: c for p, c in pairs.items() if c > 1}
    assert all(model.samples <= t <= model.samples * c for c, t in seated.values())

    def chance(u, w):
        t = seated[u, w][1] / model.samples if (u, w) in seated else min(pairs[u, w], 1)
        above = np.mean([(model.strength + model.discount * figures[u][f"t{s}"]) * figures[w][f"p{s}"] for s in range(model.samples)])
        return (pairs[u, w] - model.discount * t + above) / (model.strength + contexts[u])

    want = sorted((str(i), round(sum(math.log10(chance(u, w)) for u, w in zip([lm.START, *tokens(text)], tokens(text), strict=False)), 2)) for i, text, *_ in rows)
    for (a, x), (b, y) in zip(want, sorted((str(r["doc_id"]), round(r["score"], 2)) for r in got), strict=True):
        assert a == b and abs(x - y) <= 0.02 + 1e-5 * abs(x)


def test_probabilities_add_up_and_beat_the_base(fitted):
    rows, model, got = fitted
    figures = [r.asDict() for r in model.figures.join(model.words, "id").collect()]
    for s in range(model.samples):
        known = sum(r[f"p{s}"] for r in figures if r["n"] > 0)
        unknown = [r[f"p{s}"] for r in figures if r["n"] == 0]
        assert abs(known + unknown[0] - 1) < 1e-9 and max(unknown) == min(unknown)
    total = defaultdict(float)
    for r in got:
        if r["held_out"] and r["doc_id"] is not None:
            total["score"] += r["score"]
            total["base"] += r["base_score"]
    assert total["score"] > 0.8 * total["base"]


def test_no_documents_and_no_training(spark):
    assert lm.score(spark.createDataFrame([], SCHEMA)).collect() == []
    lone = next(i for i in range(100) if held_out(i))
    got = lm.score(spark.createDataFrame([(lone, "a b", "en", "a", 1)], SCHEMA)).collect()
    assert [tuple(r)[:5] for r in got] == [(lone, True, 3, 0, 0)] and abs(got[0]["score"]) < 1e-6 and got[0]["base_score"] == 0


def test_distinct_values_and_where_they_stand():
    rng = np.random.default_rng(6)
    for most in (5, 1 << 40, 1 << 62):  # the last does not fit beside its place
        key = rng.integers(0, most, 3_000)
        found, first, inverse = lm._distinct(key)
        want, at = np.unique(key, return_inverse=True)
        assert (found == want).all() and (inverse == at).all() and (np.sort(key)[first] == want).all()
    assert all(len(part) == 0 for part in lm._distinct(np.empty(0, np.int64)))


def test_a_word_takes_twelve_bytes_of_a_slice_and_its_figures_come_packed(spark):
    words = " ".join(f"w{i}x" for i in range(20_000))
    model = lm.Model(spark.createDataFrame([(1, words, "en", "a", 1), (2, words, "en", "a", 1)], SCHEMA), most_bytes=1 << 20)
    ids, check, n = lm.unpack(model.corpus.select("words").first()[0])
    assert len(model.corpus.select("words").first()[0]) < 12.2 * len(ids) and check.itemsize == 4 and len(n) == len(ids)
    scores = model.scores(keep=False)
    assert scores.count() == 2 and scores.agg({"score": "sum"}).first()[0] < 0


def test_words_of_several_slices_are_added_up_before_they_travel(spark):
    blobs = [(bytearray(lm.pack(np.array(ids), np.array(check, np.int32), np.array(n))),) for ids, check, n in (([5, -7], [1, 2], [3, 4]), ([5, 9], [8, 6], [10, 0]), ([5], [1], [1]))]
    made = {"n": (2, np.add), "low": (1, np.minimum), "high": (1, np.maximum)}
    got = lm._added(spark.createDataFrame(blobs, "words binary").coalesce(1), "words", made, 2).collect()
    assert sorted(tuple(r) for r in got) == [(-7, 4, 2, 2), (5, 1, 1, 1), (5, 13, 1, 8), (9, 0, 6, 6)]
