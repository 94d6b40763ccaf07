"""Topics by LDA against plain batch variational Bayes over all rows."""

import math

import numpy as np
import pytest

from cohortry.functions.special import digamma, log_gamma
from cohortry.operators import topics


def test_gamma_functions():
    x = np.array([0.01, 1 / 6, 0.5, 1.0, 3.7, 40.0, 1e5])
    assert log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-12)
    slope = [(math.lgamma(v * (1 + 1e-5)) - math.lgamma(v * (1 - 1e-5))) / (2e-5 * v) for v in x]
    assert digamma(x) == pytest.approx(slope, rel=1e-6)
    assert digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649015329, abs=1e-12)


def plain(x, k, rounds, seed=42):
    """Topics' parameters, memberships and perplexity; ``x``: rows x terms."""
    expected = lambda p: digamma(p) - digamma(p.sum(-1, keepdims=True))
    topic = np.random.default_rng(seed).gamma(100, 0.01, (k, x.shape[1]))

    def fit(row, beta):
        own = np.ones(k)
        for _ in range(100):
            before, share = own, np.exp(expected(own))
            own = 1 / k + share * (beta @ (row / (share @ beta + topics.EPS)))
            if np.abs(own - before).mean() < 1e-3:
                break
        return own

    for _ in range(rounds):
        beta, sums = np.exp(expected(topic)), np.zeros_like(topic)
        for row in x:
            share = np.exp(expected(fit(row, beta)))
            sums += np.outer(share, row / (share @ beta + topics.EPS))
        topic = 1 / k + sums * beta
    own = np.array([fit(row, np.exp(expected(topic))) for row in x])
    lg = np.vectorize(math.lgamma)
    e, b = expected(own), expected(topic)
    bound = sum(float(row @ np.log(np.exp(e[i][:, None] + b).sum(0))) for i, row in enumerate(x))
    for p, logs, size in ((own, e, k), (topic, b, x.shape[1])):
        bound += ((1 / k - p) * logs + lg(p) - math.lgamma(1 / k)).sum() + (math.lgamma(size / k) - lg(p.sum(1))).sum()
    return topic, own, math.exp(-bound / x.sum())


def test_lda_fits_every_row_in_every_round(spark):
    rng, names = np.random.default_rng(1), [f"{a}{b}word" for a in "abcd" for b in "vwxyz"]
    shares = np.array([[5.0] * 5 + [0.2] * 15, [0.2] * 10 + [4.0] * 5 + [0.3] * 5, [0.5] * 15 + [3.0] * 5])
    x = np.array([rng.multinomial(int(rng.integers(3, 40)), shares[i % 3] / shares[i % 3].sum()) for i in range(90)])
    rows = [(i, " ".join(n for n, c in zip(names, row, strict=True) for _ in range(c))) for i, row in enumerate(x)]
    counted, terms = topics.term_counts(spark.createDataFrame([*rows, (100, "none of them"), (101, ""), (102, None)], "row_id long, text string").repartition(5), "text", least=4, most=0.99, pairs=False)
    ordered = x[:, [names.index(t) for t in terms]]
    topic, own, perplexity = plain(ordered, 3, 6)
    found, got = topics.lda(counted, terms, 3, 6, at_once=64)
    assert got == pytest.approx(perplexity, rel=1e-9)
    assert [t["terms"] for t in found] == [[terms[i] for i in row.argsort()[::-1][:10]] for row in topic]
    assert [t["share"] for t in found] == pytest.approx(np.bincount(own.argmax(1), minlength=3) / len(x))
    none, perplexity = topics.lda(counted.limit(0), terms, 2, 2)
    assert [t["share"] for t in none] == [0.0, 0.0] and math.isnan(perplexity)
