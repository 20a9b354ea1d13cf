"""Seatings of Chinese restaurants, resampled dish by dish: a Gibbs step draws all tables of a dish anew, given everything else.

With weight a for the first table, a + b for the second, a + 2 b for the third and so on, c customers of a dish sit at t tables
with probability in proportion to a (a + b) ... (a + (t - 1) b) S(c, t). S(c, t) are generalised Stirling numbers: the weight
of all seatings of c customers at t tables, where a table of s customers has weight (1 - d) (2 - d) ... (s - 1 - d). Scores need
the number of tables only, so the sizes are summed out and never drawn.

Up to EXACT customers t is drawn from these weights themselves. Beyond, the mean and the variance of t are worked out from the
generating function exp(a / d (1 - (1 - x)^d)), whose n-th coefficient is the sum of a^t S(n, t) / n!, and t is drawn about them:
from the function's behaviour at x = 1, a series in z = a / d n^-d, for z up to 1; from its saddle point beyond.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

#: Customers of a dish up to which weights are worked out one by one; weights held at a time.
EXACT, TOGETHER = 1024, 1 << 21


@lru_cache(maxsize=4)
def log_ways(d: float, most: int) -> np.ndarray:
    """Logarithms of S(c, t) for c and t up to most, by S(c + 1, t) = S(c, t - 1) + (c - d t) S(c, t)."""
    out = np.full((most + 1, most + 1), -np.inf)
    if most:
        out[1, 1] = 0
    t = np.arange(1, most + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(1, most):
            stay = out[c, 1:] + np.log(np.maximum(c - d * t, 0))
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], stay)
    return out


def moments(customers: np.ndarray, a: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of the number of tables of many customers, new tables having weight a each."""
    n, large = customers.astype(float), a / d
    z = large * n**-d
    j = np.arange(1, 41)
    size = np.array([math.exp(math.lgamma(d * k + 1) - math.lgamma(k + 1)) for k in j])
    terms = -size * np.sin(math.pi * d * j) / math.pi * (-np.minimum(z, 1.0)[:, None]) ** j
    whole, once, twice = terms.sum(1), (terms * j).sum(1), (terms * j * j).sum(1)
    safe = np.where(whole == 0, 1.0, whole)
    share = np.where(whole == 0, 1.0, once / safe)
    mean, variance = large + share, large + np.where(whole == 0, 1.0, twice / safe) - share**2
    # saddle point: u = 1 - x with a (1 - u) u^(d - 1) = n
    low, high = np.full(len(n), -700.0), np.zeros(len(n))
    for _ in range(60):
        middle = (low + high) / 2
        over = np.log(a) + np.log1p(-np.exp(np.minimum(middle, -1e-300))) + (d - 1) * middle > np.log(n)
        low, high = np.where(over, middle, low), np.where(over, high, middle)
    u = np.exp(middle)
    saddle = large * (1 - u**d)
    spread = saddle - n * n / (n + a * (1 - d) * (1 - u) ** 2 * u ** (d - 2))
    far = z > 1
    return np.where(far, saddle, mean), np.maximum(np.where(far, spread, variance), 0)


def draw_tables(rng: np.random.Generator, customers: np.ndarray, a: np.ndarray, b: np.ndarray, d: float, exact: int = EXACT) -> np.ndarray:
    """Numbers of tables of dishes, each given its customers and the weights a, a + b, a + 2 b, ... of its new tables."""
    tables = np.minimum(customers, 1).astype(np.int64)
    order = np.argsort(customers, kind="stable")
    first = np.searchsorted(customers[order], np.arange(exact + 2))
    ways = log_ways(d, int(min(exact, customers.max(initial=0))))
    two = order[first[2] : first[3]] if exact >= 2 else order[:0]  # the most frequent case
    tables[two] += rng.random(len(two)) * (1 - d + a[two] + b[two]) >= 1 - d
    for c in (np.flatnonzero(np.diff(first)[3:]) + 3).tolist():
        steps, width = np.arange(c), max(1, TOGETHER // c)
        for k in range(first[c], first[c + 1], width):
            at = order[k : min(k + width, first[c + 1])]
            weight = np.cumsum(np.log(a[at, None] + b[at, None] * steps), axis=1) + ways[c, 1 : c + 1]
            run = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            tables[at] = 1 + (run < (rng.random(len(at)) * run[:, -1])[:, None]).sum(axis=1)
    at = order[first[exact + 1] :]
    if len(at):
        weight = a[at]
        for _ in range(3):  # the mean weight of the tables that there will be
            mean, variance = moments(customers[at], weight, d)
            weight = a[at] + b[at] * (np.maximum(mean, 1) - 1) / 2
        more = np.where(mean < 50, rng.poisson(np.clip(mean - 1, 0, 50)), np.rint(mean - 1 + np.sqrt(variance) * rng.standard_normal(len(at))))
        tables[at] = np.clip(1 + more, 1, customers[at])
    return tables
