"""Similarity of names, which built-in functions don't have."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F, types as T

# Fixed values of the measure: weight of the common prefix, its greatest length, and the similarity from which it counts.
_PREFIX_WEIGHT, _PREFIX_MAX, _BOOST_FROM = 0.1, 4, 0.7


def similarity(one: str, two: str) -> float:
    """Jaro-Winkler: characters matched near each other, less half of those out of order, raised for a common prefix."""
    if one == two:
        return 1.0
    reach = max(0, max(len(one), len(two)) // 2 - 1)
    taken = bytearray(len(two))
    matched, places = [], []
    for i, c in enumerate(one):
        for j in range(max(0, i - reach), min(len(two), i + reach + 1)):
            if not taken[j] and two[j] == c:
                taken[j] = 1
                matched.append(c)
                break
    if not matched:
        return 0.0
    places = [two[j] for j in range(len(two)) if taken[j]]
    m, moved = len(matched), sum(a != b for a, b in zip(matched, places, strict=True)) // 2
    jaro = (m / len(one) + m / len(two) + (m - moved) / m) / 3
    if jaro <= _BOOST_FROM:
        return jaro
    prefix = 0
    while prefix < min(_PREFIX_MAX, len(one), len(two)) and one[prefix] == two[prefix]:
        prefix += 1
    return jaro + prefix * _PREFIX_WEIGHT * (1 - jaro)


@F.arrow_udf(T.DoubleType())
def name_similarity(one: pa.Array, two: pa.Array) -> pa.Array:
    """similarity of two columns of names; null where either is. Pairs that come again in a batch are compared once."""
    known: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(one.to_pylist(), two.to_pylist(), strict=True):
        if None in pair:
            out.append(None)
            continue
        if pair not in known:
            known[pair] = similarity(*pair)
        out.append(known[pair])
    return pa.array(out, pa.float64())
