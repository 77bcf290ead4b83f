"""Set similarities from weight sums, rank weights, and blending of distances. Every one is 0 where its denominator is 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARATORS = ("jaccard", "overlap", "dice", "tversky")


def from_sums(inter: Column, a: Column, b: Column, cmp: str = "jaccard", alpha: float = 1.0, beta: float = 0.1) -> Column:
    """Similarity of two weighted sets of sums a and b with the common sum inter."""
    if cmp == "jaccard":
        top, low = inter, a + b - inter
    elif cmp == "overlap":
        top, low = inter, F.least(a, b)
    elif cmp == "dice":
        top, low = 2.0 * inter, a + b
    elif cmp == "tversky":
        top, low = inter, inter + alpha * (a - inter) + beta * (b - inter)
    else:
        raise ValueError(f"no comparator {cmp}")
    return F.when(low > 0, top / low).otherwise(0.0)


def rank_weight(rank: Column, decay: float, n_ranks: int) -> Column:
    """exp(-rank * decay); a negative decay favours the last rank."""
    r = rank.cast("double")
    return F.exp(-r * decay) if decay >= 0 else F.exp((n_ranks - 1 - r) * decay)


def rank_total(decay: float, n_ranks: int) -> float:
    import math

    return sum(math.exp(-r * decay) if decay >= 0 else math.exp((n_ranks - 1 - r) * decay) for r in range(n_ranks))


def blend(category: Column, observable: Column, weights: list[float]) -> Column:
    """Distance of a category similarity blended with an observable one, taken as a further rank behind ``weights``.

    Its weight goes on as the last two do: last * last / second to last, or half the last if there is only one.
    """
    last = weights[-1]
    nxt = last * (last / weights[-2]) if len(weights) > 1 and weights[-2] > 0 else last * 0.5
    total = sum(weights)
    return 1.0 - (category * total + observable * nxt) / (total + nxt)
