"""Chinese-restaurant seating under a Pitman-Yor prior, for many dishes at once.

The number of tables of a dish with few customers is drawn from its exact distribution given all other dishes, which is a Gibbs
step for the whole dish, as is that of larger dishes: with up to ``TABLED`` customers from the numbers of seatings, which are tabled, with
more from their asymptotic forms. So a round seats every customer anew, whatever the size of the dish. Random numbers depend on the
dish's key and the round only, so a task that runs again draws as before.

:func:`reseat` does the same customer by customer, which takes very many steps for a large dish; it is here to be compared with. A step lets one customer of
each dish stand up, chosen evenly, and sit down again: at a table of size s with weight s - discount, or at a new one with
weight (strength + discount * tables of the restaurant) * parent probability.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

#: The most customers whose numbers of seatings are tabled (8 MB).
TABLED = 1_024


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of 64-bit values."""
    x = x.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    return x ^ (x >> np.uint64(31))


def draws(keys: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in [0, 1)."""
    return (mixed(keys, salt) >> np.uint64(11)).astype(float) / float(1 << 53)


def stirling(most: int, discount: float) -> np.ndarray:
    """At [c, t]: the weight of all seatings of c customers at t tables, sizes s counting (1 - discount) * ... * (s - 1 - discount)."""
    out = np.zeros((most + 1, most + 1))
    out[0, 0] = 1
    for c in range(most):
        for t in range(c + 2):
            out[c + 1, t] = (out[c, t - 1] if t else 0) + (c - discount * t) * out[c, t]
    return out


def tables_of_few(customers: np.ndarray, tables: np.ndarray, keys: np.ndarray, restaurant: np.ndarray, parent: np.ndarray, strength: float, discount: float, salt: int, most: int = 16) -> np.ndarray:
    """Each dish's next number of tables, drawn from its distribution given the others' tables; ``customers`` from 1 to ``most``."""
    ways, others, out = stirling(most, discount), np.maximum(restaurant - tables, 0), np.ones(len(customers), np.int64)
    point = draws(keys, salt)
    for c in range(2, most + 1):
        at = np.flatnonzero(customers == c)
        if len(at):
            opened = np.cumprod((strength + discount * (others[at, None] + np.arange(c))) * parent[at, None], 1) * ways[c, 1 : c + 1]
            total = np.cumsum(opened, 1)
            out[at] = 1 + (point[at, None] * total[:, -1:] > total).sum(1)
    return np.minimum(out, customers)


@lru_cache(2)
def log_stirling(most: int, discount: float) -> np.ndarray:
    """As :func:`stirling`, in logarithms."""
    out, t = np.full((most + 1, most + 1), -np.inf), np.arange(most + 1)
    out[0, 0] = 0
    with np.errstate(divide="ignore"):
        for c in range(most):
            out[c + 1, 1 : c + 2] = np.logaddexp(out[c, : c + 1], out[c, 1 : c + 2] + np.log(np.maximum(c - discount * t[1 : c + 2], 0)))
    return out


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers."""
    y = np.asarray(x, float)
    low = 0.0
    if y.min(initial=8) < 8:
        low = np.log(np.prod([y + i for i in range(8)], 0))
        y = y + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


def _log_mean(log_z: np.ndarray, discount: float) -> np.ndarray:
    return math.log(discount) + np.log(-np.expm1(log_z)) + (discount - 1) * log_z - np.log(-np.expm1(discount * log_z))


@lru_cache(2)
def _saddles(discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of means, ascending, and where they are."""
    places = -np.logspace(-12, math.log10(700 / max(1 - discount, 0.05)), 8_192)
    known = np.maximum.accumulate(_log_mean(places, discount))
    return known, places


def log_seatings(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """Logarithms of :func:`stirling` at large ``c``, any ``t`` from 1 to c.

    c!/t! times the coefficient of x^c in ((1 - (1-x)^discount) / discount)^t: by its saddle point with the next term, where the sum of so many
    tables spreads evenly; where one table holds most, by the alternating sum over powers of (1-x)^discount."""
    c, t, d = np.broadcast_arrays(np.asarray(c, float), np.asarray(t, float), discount)
    want, (known, places) = np.log(c / t), _saddles(discount)
    log_z = np.interp(want, known, places)  # log of 1 - x, at which the mean is c / t
    for _ in range(3):
        x = -np.expm1(log_z)
        r = _log_mean(log_z, discount)
        steep = (np.exp(log_z) + (1 - discount) * x - np.exp(r + log_z)) / x
        log_z = np.minimum(log_z + (r - want) / np.maximum(steep, 1e-9), -1e-12)
    z, x = np.exp(log_z), -np.expm1(log_z)
    even = t * np.exp(discount * log_z) >= min(30.0, 6 / (1 - discount))
    out = np.zeros(c.shape)
    at = np.flatnonzero(even & (t < c))
    if len(at):
        n, k, z, x, lz = c.flat[at], t.flat[at], z.flat[at], x.flat[at], log_z.flat[at]
        r, m = n / k, z + (1 - discount) * x
        g = m - r * z
        k2 = r * g  # cumulants, times powers of z
        m1 = (1 - discount) * x
        k3 = r * g * g + r * (m1 - k2 * z)
        k4 = k2 * g * g + 2 * r * g * (m1 - k2 * z) + k2 * (m1 - k2 * z) + r * ((1 - discount) * (x * z + 2 * x * x) - k3 * z)
        more = (k4 / (8 * k2 * k2) - 5 * k3 * k3 / (24 * k2**3)) / (z * k)
        whole = k * np.log(-np.expm1(discount * lz) / discount) - n * np.log(x) - 0.5 * (np.log(2 * math.pi * k * k2) - lz) + np.log1p(np.maximum(more, -0.5))
        out.flat[at] = whole + log_gamma(n + 1) - log_gamma(k + 1)
    at = np.flatnonzero(~even & (t < c))
    if len(at):
        n, k = c.flat[at], t.flat[at]
        first = log_gamma(n - discount)
        falling, total = np.zeros(len(at)), np.zeros(len(at))
        for j in range(1, 121):
            with np.errstate(divide="ignore", invalid="ignore"):
                falling = falling + np.log(np.maximum(k - j + 1, 0)) - math.log(j)
            turns = math.sin(math.pi * j * discount) / math.pi * (-1) ** (j + 1)  # 1 / Gamma(-jd) by reflection, less its Gamma(1 + jd)
            size = np.exp(falling + log_gamma(n - j * discount) - first + math.lgamma(1 + j * discount)) if j * discount < n.min() else np.zeros(len(at))
            total += turns * size
            if (size <= 1e-14 * np.abs(total)).all():
                break
        out.flat[at] = np.log(np.maximum(total, 1e-300)) + first - k * math.log(discount) - log_gamma(k + 1)
    return out


def tables_of_many(customers: np.ndarray, tables: np.ndarray, keys: np.ndarray, restaurant: np.ndarray, parent: np.ndarray, strength: float, discount: float, salt: int) -> np.ndarray:
    """As :func:`tables_of_few`, for any number of customers. Beyond ``TABLED``, numbers of tables stand for their neighbours where the spread is wide (a quarter of it at most)."""
    others, out, point = np.maximum(restaurant - tables, 0), np.ones(len(customers), np.int64), draws(keys, salt)
    order = np.argsort(customers, kind="stable")
    c_in_order = customers[order]
    tabled = order[: np.searchsorted(c_in_order, TABLED, "right")]
    ways = log_stirling(TABLED, discount) if len(tabled) else None
    cuts = np.flatnonzero(np.diff(customers[tabled])) + 1
    for group in np.split(tabled, cuts) if len(tabled) else []:
        c = int(customers[group[0]])
        for at in np.split(group, range(max(1, (1 << 18) // c), len(group), max(1, (1 << 18) // c))):
            w = np.cumsum(np.log((strength + discount * (others[at, None] + np.arange(c))) * parent[at, None]), 1) + ways[c, 1 : c + 1]
            total = np.cumsum(np.exp(w - w.max(1, keepdims=True)), 1)
            out[at] = 1 + (point[at, None] * total[:, -1:] > total).sum(1)
    for at in np.array_split(order[len(tabled) :], math.ceil((len(order) - len(tabled)) / 256) or 1):
        if len(at):
            out[at] = _tables_of_large(customers[at], (strength + discount * others[at]) / discount, np.log(parent[at] * discount), discount, point[at])
    return np.clip(out, 1, customers)


def _tables_of_large(c: np.ndarray, begun: np.ndarray, weight: np.ndarray, discount: float, point: np.ndarray) -> np.ndarray:
    """Draws from weights log_seatings + t * weight + log_gamma(begun + t), one to a dish, by ``point``."""
    log = lambda t: log_seatings(c[:, None], t, discount) + t * weight[:, None] + log_gamma(begun[:, None] + t) - log_gamma(begun + 1)[:, None]
    low, high = np.ones(len(c)), c.astype(float)
    share = np.linspace(0, 1, 25)
    for turn in range(40):  # the highest of a grid, finer and finer between its neighbours
        grid = np.unique(np.floor(low[:, None] * (high / low)[:, None] ** share), axis=1)
        best = log(grid).argmax(1)
        rows = np.arange(len(c))
        low, high, mode = grid[rows, np.maximum(best - 1, 0)], grid[rows, np.minimum(best + 1, grid.shape[1] - 1)], grid[rows, best]
        if (high - low <= 2).all() or turn == 6:
            break
    step = np.maximum(1, np.floor(np.sqrt(mode) / 2))
    near = np.clip(mode[:, None] + step[:, None] * np.array([-1, 0, 1]), 1, c[:, None])
    seen = log(near)
    bend = np.maximum((2 * seen[:, 1] - seen[:, 0] - seen[:, 2]) / step**2, 1e-12)
    reach = np.ceil(9 / np.sqrt(bend)) + 4
    low, high = np.maximum(1, mode - reach), np.minimum(c, mode + reach)
    wide = np.maximum(1, (high - low) / 80)
    grid = low[:, None] + wide[:, None] * np.arange(81)
    whole = np.where(grid <= high[:, None], np.clip(np.round(grid), 1, c[:, None]), 1)
    w = np.where(grid <= high[:, None] + 0.5, log(whole), -np.inf)
    w = np.exp(w - w.max(1, keepdims=True))
    total = np.cumsum(w, 1)
    goal = point * total[:, -1]
    at = np.minimum((goal[:, None] > total).sum(1), 80)
    rows = np.arange(len(c))
    inside = (goal - (total[rows, at] - w[rows, at])) / np.maximum(w[rows, at], 1e-300) - 0.5
    return np.round(grid[rows, at] + np.where(wide > 1, inside * wide, 0)).astype(np.int64)


def first_seating(customers: np.ndarray, strength: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dish, size, tables) to begin with: about the expected number of tables, all but one of a single customer."""
    seated, tables = np.ones(len(customers)), np.ones(len(customers))
    while (left := customers - seated).max(initial=0) > 0:
        step = np.clip(np.maximum(1, seated * 0.25), 0, left)
        tables = np.minimum(tables + step * strength / (strength + seated - discount * tables), seated + step)
        seated = seated + step
    tables = np.clip(np.round(tables).astype(np.int64), 1, customers)
    dish, rest = np.arange(len(customers)), customers - tables + 1
    alone, more = np.where(rest == 1, tables, tables - 1), rest > 1
    found = np.concatenate([dish[alone > 0], dish[more]]), np.concatenate([np.ones((alone > 0).sum(), np.int64), rest[more]]), np.concatenate([alone[alone > 0], np.ones(more.sum(), np.int64)])
    return _merged(*found, int(customers.max(initial=0)))


def _merged(dish: np.ndarray, size: np.ndarray, tables: np.ndarray, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by dish and size, one entry each, none empty."""
    key = dish * (largest + 2) + size
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    total = np.add.reduceat(tables[order], first) if len(first) else tables[:0]
    kept = total > 0
    at = order[first[kept]]
    return dish[at], size[at], total[kept]


def reseat(dish: np.ndarray, size: np.ndarray, tables: np.ndarray, keys: np.ndarray, customers: np.ndarray, restaurant: np.ndarray, parent: np.ndarray, strength: float, discount: float, steps: int, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(dish, size, tables) after ``steps`` Gibbs steps, and each dish's number of tables. Entries come sorted by dish; every dish has
    a customer. ``restaurant``: the tables of each dish's whole restaurant, its own included."""
    n, every, largest = len(customers), np.arange(len(customers)), int(customers.max(initial=0))
    own = np.bincount(dish, tables, n).astype(np.int64)
    others = np.maximum(restaurant - own, 0)
    for step in range(steps if n else 0):
        begin = np.searchsorted(dish, every)
        total = np.cumsum(size * tables)
        before = np.where(begin > 0, total[begin - 1], 0)
        rises = np.searchsorted(total, before + np.minimum((draws(keys, salt + 2 * step) * customers).astype(np.int64), customers - 1), "right")
        left = size[rises]
        tables = tables.copy()
        tables[rises] -= 1
        own -= left == 1
        stays = left > 1
        dish, size, tables = np.concatenate([dish, every[stays]]), np.concatenate([size, left[stays] - 1]), np.concatenate([tables, np.ones(stays.sum(), np.int64)])
        order = np.argsort(dish, kind="stable")
        dish, size, tables = dish[order], size[order], tables[order]
        weight = (size - discount) * tables
        begin, end = np.searchsorted(dish, every), np.searchsorted(dish, every, "right")
        total = np.cumsum(weight)
        before = np.where(begin > 0, total[begin - 1], 0.0)
        known = total[end - 1] - before
        point = draws(keys, salt + 2 * step + 1) * (known + (strength + discount * (others + own)) * parent)
        at = np.clip(np.searchsorted(total, before + point, "right"), begin, end - 1)
        new = (point >= known) | (tables[at] == 0)
        tables[at[~new]] -= 1
        own += new
        dish, size, tables = np.concatenate([dish, every]), np.concatenate([size, np.where(new, 1, size[at] + 1)]), np.concatenate([tables, np.ones(n, np.int64)])
        dish, size, tables = _merged(dish, size, tables, largest)
    return dish, size, tables, own
