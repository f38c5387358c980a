"""Plan tables: seeded NumPy draws as small DataFrames that the analysis joins.

The draws follow NumPy's PCG64 call by call, so a plan is bit-equal wherever
it is built; its size depends on the number of groups and repeats, never on
the number of recordings.
"""

from __future__ import annotations

import hashlib
import itertools
from math import comb

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, columns: dict[str, np.ndarray]) -> DataFrame:
    import pyarrow as pa

    return spark.createDataFrame(pa.table(columns))


def seed_of(*parts: object) -> int:
    """First four bytes, big-endian, of the SHA-256 of parts joined by '|', as ``hashing.seed_be4``."""
    return int.from_bytes(hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:4], "big")


def permutations(spark: SparkSession, items: list, repeats: int, seed: int) -> DataFrame:
    """(rep, pos, item): one permutation of ``items`` each."""
    rng = np.random.default_rng(seed)
    n = len(items)
    order = np.concatenate([rng.permutation(n) for _ in range(repeats)]) if repeats else np.zeros(0, int)
    return _table(spark, {"rep": np.repeat(np.arange(repeats), n), "pos": np.tile(np.arange(n), repeats), "item": np.array(items)[order]})


def bootstraps(spark: SparkSession, items: list, repeats: int, seed: int) -> DataFrame:
    """(rep, pos, item): as many draws with replacement as there are items."""
    rng = np.random.default_rng(seed)
    n = len(items)
    drawn = np.concatenate([rng.choice(n, size=n, replace=True) for _ in range(repeats)]) if repeats else np.zeros(0, int)
    return _table(spark, {"rep": np.repeat(np.arange(repeats), n), "pos": np.tile(np.arange(n), repeats), "item": np.array(items)[drawn]})


def block_draws(spark: SparkSession, sizes: list[int], repeats: int, seeds: list[int], replace: bool) -> DataFrame:
    """(n_blocks, rep, items): redraws (or with ``replace`` false permutations) of 0 to n_blocks - 1, for each size and seed."""
    n, rep, items = [], [], []
    for size in sizes:
        for s, seed in enumerate(seeds):
            rng = np.random.default_rng(seed)
            n += [size] * repeats
            rep += range(s * repeats, (s + 1) * repeats)
            items += [rng.choice(size, size=size, replace=True) if replace else rng.permutation(size) for _ in range(repeats)]
    return _table(spark, {"n_blocks": np.array(n), "rep": np.array(rep), "items": _lists(items)})


def sign_draws(spark: SparkSession, n: int, repeats: int, seed: int) -> DataFrame:
    """(rep, signs): drawn sign vectors of length ``n``, one call of the generator each."""
    rng = np.random.default_rng(seed)
    signs = [rng.choice([-1.0, 1.0], size=n).astype(np.int32) for _ in range(repeats)]
    return _table(spark, {"rep": np.arange(repeats), "signs": _lists(signs)})


def capped_draw(spark: SparkSession, groups: dict, cap: int, n: int, seed: int) -> DataFrame:
    """(pos, item): ``n`` items drawn from up to ``cap`` of each group, or from all where these are fewer than ``n``.

    Groups are taken in order; one generator (seed + 17) draws inside each and
    then among the candidates.
    """
    rng = np.random.default_rng(seed + 17)
    kept, whole = [], [x for name in sorted(groups) for x in groups[name]]
    for name in sorted(groups):
        items = groups[name]
        kept += [items[i] for i in rng.choice(len(items), size=min(cap, len(items)), replace=False)]
    pool = kept if len(kept) >= n else whole
    if len(pool) < n:
        raise ValueError(f"{len(pool)} items; {n} are to be drawn")
    chosen = [pool[i] for i in rng.choice(len(pool), size=n, replace=False)]
    return _table(spark, {"pos": np.arange(n), "item": np.array(chosen)})


def stratified_bootstraps(spark: SparkSession, groups: dict, repeats: int, seed: int) -> DataFrame:
    """(rep, pos, item, stratum): draws with replacement within each stratum."""
    rng = np.random.default_rng(seed)
    strata = np.concatenate([np.repeat([s], len(items)) for s, items in groups.items()])
    drawn = [np.array(items)[rng.choice(len(items), size=len(items), replace=True)] for _ in range(repeats) for items in groups.values()]
    n = len(strata)
    return _table(spark, {"rep": np.repeat(np.arange(repeats), n), "pos": np.tile(np.arange(n), repeats), "item": np.concatenate(drawn), "stratum": np.tile(strata, repeats)})


def label_permutations(spark: SparkSession, labels: dict, repeats: int, seed: int) -> DataFrame:
    """(rep, item, label): the labels shuffled over the items."""
    rng = np.random.default_rng(seed)
    items, values = list(labels), np.array(list(labels.values()))
    shuffled = np.concatenate([values[rng.permutation(len(items))] for _ in range(repeats)])
    return _table(spark, {"rep": np.repeat(np.arange(repeats), len(items)), "item": np.tile(np.array(items), repeats), "label": shuffled})


def subsets(spark: SparkSession, items: list, size: int, repeats: int, seed: int, most: int = 50_000) -> DataFrame:
    """(rep, item): all subsets where there are at most ``most``, else seeded draws without replacement."""
    if comb(len(items), size) <= most:
        chosen = list(itertools.combinations(items, size))
    else:
        rng = np.random.default_rng(seed)
        chosen = [tuple(items[i] for i in rng.choice(len(items), size=size, replace=False)) for _ in range(repeats)]
    return _table(spark, {"rep": np.repeat(np.arange(len(chosen)), size), "item": np.array(chosen).reshape(-1)})


def paired_subsets(spark: SparkSession, comparisons: list[tuple], repeats: int, seed: int) -> DataFrame:
    """(test, fam, n, real, a, b): draws of two groups' sizes from two pools, and the groups themselves (``real``).

    ``comparisons``: (test, fam, group_a, pool_a, group_b, pool_b). The draws of
    a comparison alternate in one stream; equal ones are one row, ``n`` counts them.
    """
    keys, ns, reals, a, b = [], [], [], [], []
    for test, fam, group_a, pool_a, group_b, pool_b in comparisons:
        rng = np.random.default_rng(seed_of("H3b_perm", test, fam, seed))
        na, nb = len(group_a), len(group_b)
        drawn = np.empty((repeats + 1, na + nb), np.int32)
        drawn[repeats] = [*group_a, *group_b]
        for rep in range(repeats):
            drawn[rep, :na] = np.array(pool_a)[rng.choice(len(pool_a), size=na, replace=False)]
            drawn[rep, na:] = np.array(pool_b)[rng.choice(len(pool_b), size=nb, replace=False)]
        drawn[:, :na].sort(axis=1)
        drawn[:, na:].sort(axis=1)
        found, at, n = np.unique(drawn, axis=0, return_inverse=True, return_counts=True)
        real = np.arange(len(found)) == at.reshape(-1)[repeats]
        keys += [(test, fam)] * len(found)
        ns.append(n - real)
        reals.append(real)
        a += list(found[:, :na])
        b += list(found[:, na:])
    test, fam = zip(*keys)
    return _table(spark, {"test": np.array(test), "fam": np.array(fam), "n": np.concatenate(ns), "real": np.concatenate(reals), "a": _lists(a), "b": _lists(b)})


def family_draws(spark: SparkSession, families: list, repeats: int, seed: int, most: int = 50_000) -> DataFrame:
    """(family, kind, a, b): positions inside and outside of each family in ``families``, one label for each item.

    Kinds: 'observed' (the family itself), 'exact' or 'drawn' (subsets of the
    family's size and the rest), 'boot' (both sides drawn with replacement).
    """
    labels, everything, rows = np.array(families), np.arange(len(families)), []
    for family in sorted(set(families)):
        inside, outside = np.flatnonzero(labels == family), np.flatnonzero(labels != family)
        n, k = len(labels), len(inside)
        rows.append((family, "observed", inside, outside))
        if comb(n, k) <= most:
            kind, chosen = "exact", (np.array(c) for c in itertools.combinations(range(n), k))
        else:
            rng = np.random.default_rng(seed_of("H4F_PERM", family, seed))
            kind, chosen = "drawn", (np.sort(rng.choice(everything, size=k, replace=False)) for _ in range(repeats))
        rows += [(family, kind, a, np.setdiff1d(everything, a, assume_unique=True)) for a in chosen]
        if len(outside):
            rng = np.random.default_rng(seed_of("H4F_BOOT", family, seed))
            rows += [(family, "boot", rng.choice(inside, size=k, replace=True), rng.choice(outside, size=n - k, replace=True)) for _ in range(repeats)]
    family, kind, a, b = zip(*rows)
    return _table(spark, {"family": np.array(family), "kind": np.array(kind), "a": _lists(a), "b": _lists(b)})


def _lists(arrays: list[np.ndarray] | tuple[np.ndarray, ...]):
    import pyarrow as pa

    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays), pa.int32()))
