"""Similarities and transforms of vectors held as arrays of doubles.

Each works inside its row, so comparing two profiles moves no bins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once; inside a lambda it would be once for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def centred(a: Column) -> Column:
    return let(total(a) / F.size(a), lambda mean: F.transform(a, lambda x: x - mean))


def cosine(a: Column, b: Column, on_degenerate: float | None = None) -> Column:
    """Null, or ``on_degenerate``, where a norm is 0."""
    return let(norm(a) * norm(b), lambda size: F.when(size > 0, dot(a, b) / size).otherwise(F.lit(on_degenerate).cast("double")))


def pearson(a: Column, b: Column, on_degenerate: float | None = None) -> Column:
    return let(F.struct(centred(a).alias("x"), centred(b).alias("y")), lambda s: cosine(s["x"], s["y"], on_degenerate))


def average_ranks(a: Column) -> Column:
    """Ranks from 1; ties share their mean rank."""
    return F.transform(a, lambda x: F.size(F.filter(a, lambda y: y < x)) + (F.size(F.filter(a, lambda y: y == x)) + 1) / F.lit(2.0))


def spearman(a: Column, b: Column) -> Column:
    return pearson(average_ranks(a), average_ranks(b))


def euclidean(a: Column, b: Column) -> Column:
    return norm(F.zip_with(a, b, lambda x, y: x - y))


def rmse(a: Column, b: Column) -> Column:
    return euclidean(a, b) / F.sqrt(F.size(a).cast("double"))


def mae(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y))) / F.size(a)


def median(a: Column) -> Column:
    """Median of an array; the mean of the two middle values for an even size."""
    n = F.size(a)
    return let(F.array_sort(a), lambda s: (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def median_of(arrays: Column) -> Column:
    """Bin-wise median of an array of equally long arrays."""
    bins = F.sequence(F.lit(0), F.size(F.get(arrays, F.lit(0))) - 1)
    return F.transform(bins, lambda b: median(F.transform(arrays, lambda a: F.get(a, b))))


def quantile(a: Column, q: float) -> Column:
    """Linear interpolation between order statistics."""
    at = (F.size(a) - 1) * F.lit(q)
    low = F.floor(at).cast("int")

    def between(s: Column) -> Column:
        x, y = F.get(s, low), F.coalesce(F.get(s, low + 1), F.get(s, low))
        return x + (y - x) * (at - low)

    return let(F.array_sort(a), between)


def top_bins(a: Column, fraction: float = 0.1) -> Column:
    """Positions of the ceil(fraction * n) largest |x|, at least one; ties by position."""
    k = F.greatest(F.lit(1), F.ceil(F.size(a) * F.lit(fraction)).cast("int"))
    ranked = F.array_sort(F.transform(a, lambda x, i: F.struct((-F.abs(x)).alias("v"), i.alias("i"))))
    return F.transform(F.slice(ranked, F.lit(1), k), lambda s: s["i"])


def threshold_bins(a: Column, q: float = 0.9, signed: bool = False) -> Column:
    """Positions whose |x| reaches the q quantile of |x|; ``signed``: told apart by sign."""
    mark = lambda cut: F.transform(a, lambda x, i: F.when(F.abs(x) >= cut, i if not signed else i * 4 + F.signum(x).cast("int") + 1))
    return F.array_compact(let(quantile(F.transform(a, lambda x: F.abs(x)), q), mark))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays; null for an empty union."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union)


def signed_jaccard(a: Column, b: Column, q: float = 0.9) -> Column:
    """Common positions of equal sign over the union of positions."""
    same = F.size(F.array_intersect(threshold_bins(a, q, True), threshold_bins(b, q, True)))
    return same / F.size(F.array_union(threshold_bins(a, q), threshold_bins(b, q)))


def wasserstein(a: Column, b: Column, hz: Column) -> Column:
    """Area between the two cumulated |x| shares over the axis; null without weight."""
    steps = F.zip_with(F.slice(hz, F.lit(2), F.size(hz) - 1), F.slice(hz, F.lit(1), F.size(hz) - 1), lambda x, y: x - y)
    wa, wb = F.transform(a, lambda x: F.abs(x)), F.transform(b, lambda x: F.abs(x))
    sa, sb = total(wa), total(wb)
    gap = let(F.struct(sa.alias("a"), sb.alias("b")), lambda s: F.zip_with(wa, wb, lambda x, y: F.try_divide(x, s["a"]) - F.try_divide(y, s["b"])))
    start = F.struct(F.lit(0.0).alias("at"), F.lit(0.0).alias("area"))
    moved = F.zip_with(F.slice(gap, F.lit(1), F.size(hz) - 1), steps, lambda g, d: F.struct(g.alias("g"), d.alias("d")))
    done = F.aggregate(moved, start, lambda s, m: F.struct((s["at"] + m["g"]).alias("at"), (s["area"] + F.abs(s["at"] + m["g"]) * m["d"]).alias("area")))
    return F.when((sa > 0) & (sb > 0), done["area"])


def l2_normalised(a: Column) -> Column:
    """A norm of at most 1e-12 counts as 1."""
    return let(norm(a), lambda n: let(F.when(n <= 1e-12, F.lit(1.0)).otherwise(n), lambda size: F.transform(a, lambda x: x / size)))


def is_finite(a: Column) -> Column:
    """No null, NaN or infinity in the array."""
    return ~F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
