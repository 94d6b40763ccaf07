"""TF-IDF, topics by non-negative factors and by LDA."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizerModel, NGram, RegexTokenizer, StopWordsRemover
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.expressions import rounded
from cohortry.functions.special import digamma, log_gamma
from cohortry.operators.resample import _passed

EPS = np.finfo(float).eps


def term_counts(df: DataFrame, col: str, least: int = 4, most: float = 0.6, size: int = 1500, pairs: bool = True, key: str = "row_id"):
    """key and ``counts`` over words (and word pairs) that are in at least ``least`` rows and at most that share; and the terms."""
    words = RegexTokenizer(inputCol=col, outputCol="_w", pattern=r"[^\p{L}]+", minTokenLength=3).transform(df.filter(F.col(col).isNotNull()))
    clean = StopWordsRemover(inputCol="_w", outputCol="_c").transform(words)
    joined = NGram(n=2, inputCol="_c", outputCol="_p").transform(clean).withColumn("_t", F.concat("_c", "_p")) if pairs else clean.withColumnRenamed("_c", "_t")
    model = CountVectorizerModel.from_vocabulary(vocabulary(joined.select("_t"), least, most, size), inputCol="_t", outputCol="counts")
    return model.transform(joined).select(key, "counts"), model.vocabulary


def vocabulary(rows: DataFrame, least: int, most: float, size: int) -> list[str]:
    """The ``size`` most frequent terms of the arrays ``_t``, ties by name, that are in at least ``least`` rows and at most the share ``most`` (a number, from 1 on).

    Terms are grouped by a shuffle with the session's partitions; :class:`CountVectorizer` keeps all distinct ones as objects in as many as the input has."""
    first = F.transform(F.col("s"), lambda x, i: F.struct(x.alias("term"), F.when(i == 0, 1).otherwise((F.get("s", i - 1) != x).cast("int")).alias("first")))
    counts = rows.select(F.array_sort("_t").alias("s")).select(F.inline(first)).groupBy("term").agg(F.count("*").alias("n"), F.sum("first").alias("df"))
    highest = most if most >= 1 else most * rows.count()
    kept = counts.filter((F.col("df") >= least) & (F.col("df") <= highest)).orderBy(F.desc("n"), "term").limit(size)
    return [r["term"] for r in kept.collect()]  # ``size`` at most


def tfidf(counted: DataFrame, terms: list[str], key: str = "row_id") -> DataFrame:
    """Long form: key, term number, weight; smooth idf plus one, rows of unit length. Rows without a term are absent."""
    from pyspark.ml.functions import vector_to_array

    long = counted.select(key, F.posexplode(vector_to_array("counts")).alias("t", "n")).filter("n > 0")
    idf = long.groupBy("t").agg((F.ln((1 + F.lit(counted.count())) / (1 + F.count("*"))) + 1).alias("idf"))
    raw = long.join(F.broadcast(idf), "t").withColumn("w", F.col("n") * F.col("idf"))  # at most vocabulary-many rows
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_l"))
    return raw.join(norm, key).select(key, "t", (F.col("w") / F.col("_l")).alias("w"))


def empty_rate(df: DataFrame, weights: DataFrame, script, key: str = "row_id") -> DataFrame:
    """Per script: rows and the share left without any term."""
    have = weights.select(key).distinct().withColumn("_h", F.lit(1))
    return df.join(have, key, "left").groupBy(script.alias("script")).agg(F.count("*").alias("n"), rounded(100.0 * F.avg(F.col("_h").isNull().cast("double"))).alias("pct_empty"))


def nmf(weights: DataFrame, n_terms: int, topics: int = 6, rounds: int = 30, seed: int = 42, key: str = "row_id", top: int = 8, terms: list[str] | None = None) -> list[dict]:
    """Non-negative factors by multiplicative updates: the terms' factors (topics x terms, bounded) are on the driver, the rows' are joined products.

    Each round is one pass: every row solves for its own memberships given the terms, and sums of topics x topics and topics x terms come back.
    """
    h = np.random.default_rng(seed).uniform(0.1, 1, (topics, n_terms))
    rows = weights.groupBy(key).agg(F.collect_list("t").alias("t"), F.collect_list("w").alias("w")).cache()
    spark = weights.sparkSession

    def member(h, t, w):
        x, gram = h[:, t] @ w, h @ h.T
        m = np.full(topics, 1 / topics)
        for _ in range(30):
            m *= x / (gram @ m + 1e-12)
        return m

    def sums(now):
        shared = spark.sparkContext.broadcast(now)

        def part(batches):
            a, b, share = np.zeros((topics, topics)), np.zeros((topics, n_terms)), np.zeros(topics)
            for batch in batches:
                for t, w in zip(batch["t"], batch["w"], strict=True):
                    m = member(shared.value, np.asarray(t), np.asarray(w))
                    a += np.outer(m, m)
                    b[:, t] += np.outer(m, w)
                    share[m.argmax()] += 1
            import pandas as pd

            yield pd.DataFrame({"i": range(topics), "a": list(a), "b": list(b), "n": share})

        got = rows.mapInPandas(part, "i int, a array<double>, b array<double>, n double").groupBy("i").agg(F.array(*[F.sum(F.get("a", F.lit(j))) for j in range(topics)]).alias("a"), F.array(*[F.sum(F.get("b", F.lit(j))) for j in range(n_terms)]).alias("b"), F.sum("n").alias("n")).orderBy("i").collect()
        return np.array([r["a"] for r in got]), np.array([r["b"] for r in got]), np.array([r["n"] for r in got])

    for _ in range(rounds):
        a, b, share = sums(h)
        h *= b / (a @ h + 1e-12)
    rows.unpersist()
    names = terms or [str(i) for i in range(n_terms)]
    return [{"topic": k, "terms": [names[i] for i in h[k].argsort()[::-1][:top]], "share": float(share[k] / max(share.sum(), 1))} for k in range(topics)]


def _sparse(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms and counts of all rows one after the other, and how many terms each row has; rows without one are left out."""
    t, n = batch.column(0).field("indices"), batch.column(0).field("values")
    lengths = np.diff(t.offsets.to_numpy())
    return t.flatten().to_numpy(), n.flatten().to_numpy(), lengths[lengths > 0]


def _blocks(t: np.ndarray, n: np.ndarray, lengths: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Terms and counts as matrices of rows of about one length, up to ``most`` values each; shorter rows are filled up with counts of zero."""
    order, begin = np.argsort(lengths, kind="stable"), np.cumsum(lengths) - lengths
    low = 0
    while low < len(order):
        high = low + int(np.searchsorted(np.arange(1, len(order) - low + 1) * lengths[order[low:]], most, "right"))
        rows, low = order[low : max(high, low + 1)], max(high, low + 1)
        place = np.arange(lengths[rows[-1]])
        inside = place < lengths[rows, None]
        at = np.where(inside, begin[rows, None] + place, 0)
        yield t[at], np.where(inside, n[at], 0.0)


def _expected(parameters: np.ndarray) -> np.ndarray:
    """Expected logarithms of Dirichlet shares, a row each."""
    return digamma(parameters) - digamma(parameters.sum(1, keepdims=True))


def _memberships(b: np.ndarray, n: np.ndarray, prior: float, most: int = 100, close: float = 1e-3) -> np.ndarray:
    """Dirichlet parameters of the topics' shares (rows x topics): each row's steps end when they move it by less than ``close`` on average. ``b``: rows x topics x terms."""
    own = np.ones(b.shape[:2])
    found, live, moving = own.copy(), np.arange(len(b)), np.ones(len(b), bool)
    for _ in range(most):
        share = np.exp(_expected(own))
        norm = np.matmul(share[:, None], b)[:, 0] + EPS
        after = prior + share * np.matmul(b, (n / norm)[:, :, None])[:, :, 0]
        found[live[moving]] = after[moving]
        moving &= np.abs(after - own).mean(1) >= close
        own = after
        if not moving.any():
            break
        if moving.mean() < 0.75:
            live, own, b, n = live[moving], own[moving], b[moving], n[moving]
            moving = np.ones(len(live), bool)
    return found


def lda(counted: DataFrame, terms: list[str], topics: int = 6, rounds: int = 50, seed: int = 42, top: int = 10, at_once: int = 1 << 16) -> tuple[list[dict], float]:
    """Topics (their first ``top`` terms, and the share of rows, of those with a term, that have most of theirs in it) and the perplexity of a row's word.

    Batch variational Bayes, with priors of 1 / ``topics``: in each of ``rounds`` passes every row is fitted to the topics, and the topics
    become what all rows give them. The topics' parameters (topics x terms) are all that reaches the driver. Spark's own LDA draws a share of the rows in each
    round, with repeats, and moves the topics a part of the way. ``counted``: as :func:`term_counts` gives it."""
    prior, size = 1 / topics, len(terms)
    rows = counted.select("counts").repartition(max(counted.rdd.getNumPartitions(), counted.sparkSession.sparkContext.defaultParallelism)).cache()  # every round reads it
    now = np.random.default_rng(seed).gamma(100, 0.01, (topics, size))
    for _ in range(rounds):
        beta = np.exp(_expected(now))

        def gather(total, t, n, lengths, beta=np.ascontiguousarray(beta.T)):
            for t, n in _blocks(t, n, lengths, at_once):
                b = np.ascontiguousarray(beta[t].transpose(0, 2, 1))
                share = np.exp(_expected(_memberships(b, n, prior)))
                n /= np.matmul(share[:, None], b)[:, 0] + EPS
                for sums, own in zip(total[0], share.T, strict=True):
                    sums += np.bincount(t.ravel(), (own[:, None] * n).ravel(), size)

        (sums,), _ = _passed(rows, size, [(topics, size)], gather, read=_sparse)
        now = prior + sums * beta

    logs = _expected(now)

    def score(total, t, n, lengths, logs=np.ascontiguousarray(logs.T)):
        for t, n in _blocks(t, n, lengths, at_once):
            b = np.ascontiguousarray(logs[t].transpose(0, 2, 1))
            found = _memberships(np.exp(b), n, prior)
            own = _expected(found)
            b += own[:, :, None]
            highest = b.max(1)
            bound = (n * (np.log(np.exp(b - highest[:, None]).sum(1)) + highest)).sum() + ((prior - found) * own + log_gamma(found) - math.lgamma(prior)).sum()
            bound += (math.lgamma(prior * topics) - log_gamma(found.sum(1))).sum()
            total[0] += [bound, n.sum()]
            total[1] += np.bincount(found.argmax(1), minlength=topics)

    ((bound, words), share), _ = _passed(rows, size, [(2,), (topics,)], score, read=_sparse)
    rows.unpersist()
    bound += float(((prior - now) * logs + log_gamma(now) - math.lgamma(prior)).sum()) + topics * math.lgamma(prior * size) - float(log_gamma(now.sum(1)).sum()) if size else 0.0
    found = [{"topic": k, "terms": [terms[i] for i in now[k].argsort(kind="stable")[::-1][:top]], "share": float(share[k] / max(share.sum(), 1))} for k in range(topics)]
    return found, math.exp(-bound / words) if words else math.nan
