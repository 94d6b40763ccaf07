"""The prefix trie against a brute-force version, with good and with poor fingerprints."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from cohortry.llm import trie
from cohortry.llm.ordered import PRIME, numbered, running

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    said = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            said[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in said.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        first = c - int(c - 5 * int(c / 5))
        made[c] = own.get(first, [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[q] for q in children[p])
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return {(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], sha(p)) for p, m in members.items()}


def made_rows(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for c in range(-12, n):
        if rng.random() < 0.1:
            continue
        for t in range(rng.choice([1, 2, 3, 9, 14])):
            rows.append((c, rng.choice([t, t, t, None, 3]), rng.choice(["user", "assistant", "", None]), rng.choice(["a", "b", "", None, "ü𝄞", "long " * 40])))
    rows += rows[:10] + [(5, 1, "user", "same")] * 150 + [(None, 0, "user", "lost")] + [(1000 + i, 0, "user", "hello") for i in range(40)]
    rows += [(2000, i, "user", f"turn {i % 7}") for i in range(500)] + [(2003, i, "user", f"turn {i % 7}") for i in range(300)]
    return rows


@pytest.mark.parametrize(("seed", "bits", "prime"), [(1, 61, PRIME), (2, 2, PRIME), (3, 61, 31), (4, 3, 7)])
def test_trie_is_that_of_brute_force(spark, seed, bits, prime):
    rows = made_rows(seed)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS depth", "'x' AS hash", "2 AS conv", "3 AS _n").repartition(3)
    got = trie.trie(df, bits, prime).collect()
    assert {tuple(r) for r in got} == brute(rows) and len(got) == len(brute(rows))


def test_empty_and_turnless(spark):
    assert trie.trie(spark.createDataFrame([], SCHEMA)).collect() == []
    lone = next(c for c in range(1, 2000) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(lone, 0, "user", "gone")]
    assert {tuple(r) for r in trie.trie(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows)


def test_running_sums_and_places(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, 9]), i, rng.randrange(PRIME), rng.randrange(100)) for i in range(5_000)]
    df = spark.createDataFrame(rows, "k long, o long, x long, v long").repartition(5)
    want, sums, plain = {}, defaultdict(int), defaultdict(int)
    for k, o, x, v in rows:
        sums[k], plain[k] = (sums[k] + x) % PRIME, plain[k] + v
        want[o] = (sums[k], plain[k])
    with_prime = {r["o"]: r["run_x"] for r in running(df, "k", ["o"], ["x"], "t", PRIME).collect()}
    without = {r["o"]: r["run_v"] for r in running(df, "k", ["o"], ["v"], "t").collect()}
    assert {o: (with_prime[o], without[o]) for o in want} == want
    assert [r["at"] for r in numbered(df, ["o"], "t").orderBy("o").collect()] == list(range(5_000))
