"""Similarities of titles, names and word lists."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters; none where the text is shorter."""
    n = F.length(text)
    starts = F.when(n >= 3, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(3))))


def jaccard(a: Column, b: Column) -> Column:
    """Intersection over union of two arrays; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Intersection over the smaller of two arrays."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))


def jaro_winkler(a: str, b: str, prefix: float = 0.1) -> float:
    """Jaro similarity, raised by a common prefix of up to four characters where it is over 0.7."""
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    taken, left = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                left.append(x)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [x for x, t in zip(b, taken, strict=True) if t]
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return jaro + same * prefix * (1 - jaro) if jaro > 0.7 else jaro


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel: a row of the table is one integer."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    whole = (1 << len(a)) - 1
    row = whole
    for y in b:
        hit = row & places.get(y, 0)
        row = ((row + hit) | (row - hit)) & whole
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """0 to 100: twice the longest common subsequence over both lengths."""
    return 200.0 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    """``ratio`` of the sorted words; lower case."""
    return ratio(*(" ".join(sorted(x.lower().split())) for x in (a, b)))


def token_set_ratio(a: str, b: str) -> float:
    """The best ``ratio`` of the shared words, and of these with either side's other words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared = " ".join(sorted(x & y))
    full = [" ".join(filter(None, (shared, " ".join(sorted(z - (x & y)))))) for z in (x, y)]
    if shared and shared in full:
        return 100.0
    pairs = [full] + [[shared, f] for f in full] * bool(shared)
    return max(ratio(*p) for p in pairs)


def _pairwise(f):
    def over(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return over


jaro_winkler_udf = F.pandas_udf(_pairwise(jaro_winkler), T.DoubleType())
ratio_udf = F.pandas_udf(_pairwise(ratio), T.DoubleType())
token_sort_udf = F.pandas_udf(_pairwise(token_sort_ratio), T.DoubleType())
token_set_udf = F.pandas_udf(_pairwise(token_set_ratio), T.DoubleType())


def trigram_mean(a: Column, b: Column) -> Column:
    """Harmonic mean of the trigrams' Jaccard similarity and containment."""
    x, y = trigrams(a), trigrams(b)
    j, c = jaccard(x, y), containment(x, y)
    return F.when(j + c > 0, 2 * j * c / (j + c)).otherwise(F.lit(0.0))


def pair_similarity(a: Column, b: Column) -> Column:
    """The better of Jaro-Winkler and ``trigram_mean`` for two normal titles; 0 if one is empty."""
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(F.greatest(jaro_winkler_udf(a, b), trigram_mean(a, b)))


def variants_similarity(a: Column, b: Column) -> Column:
    """The best ``pair_similarity`` of two arrays of at most two variants."""
    each = [pair_similarity(F.coalesce(F.get(a, i), F.lit("")), F.coalesce(F.get(b, j), F.lit(""))) for i in (0, 1) for j in (0, 1)]
    return F.greatest(*each)


def best_unit(quoted: Column, units: Column) -> Column:
    """(at, score) of the unit that shares most words with the quote, the earliest of the best; null where none shares any."""
    from citeloom.functions.text import words

    own = words(quoted)
    scored = F.transform(units, lambda u, i: F.struct(jaccard(own, words(u)).alias("score"), (-i).alias("minus")))
    best = F.array_max(F.filter(scored, lambda s: s["score"] > 0))
    return F.when(best.isNotNull(), F.struct((-best["minus"]).alias("at"), best["score"].alias("score")))


def ordered_matches(short: list[str], long: list[str]) -> int:
    """Words of the short list that the long one has in order; two words may be one in either list.

    A word that the other list has no more of is left out.
    """
    queue, rest, matched = list(reversed(short)), list(reversed(long)), 0
    while queue and rest:
        x, y = queue[-1], rest[-1]
        pair_of = lambda z: z[-1] + z[-2] if len(z) > 1 else None
        taken = (1, 1) if x == y else (1, 2) if x == pair_of(rest) else (2, 1) if y == pair_of(queue) else None
        if taken:
            matched += 1
        else:
            taken = (0, 1) if x in rest[:-1] else (1, 0)
        del queue[len(queue) - taken[0] :], rest[len(rest) - taken[1] :]
    return matched


@F.pandas_udf(T.IntegerType())
def ordered_matches_udf(short: pd.Series, long: pd.Series) -> pd.Series:
    return pd.Series([ordered_matches(list(a), list(b)) for a, b in zip(short, long, strict=True)], dtype="int32")
