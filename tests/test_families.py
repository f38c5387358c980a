"""Family tests against plain NumPy."""

import itertools

import numpy as np
import pytest

from loomvec import queries as Q
from loomvec import queries_more as M
from loomvec.operators import analysis as A
from loomvec.operators import inference as I
from loomvec.plans import tables


def pair_table(spark, x, labels):
    n = np.linalg.norm(x, axis=1)
    sim = x @ x.T / np.outer(n, n)
    rows = [(i, j, labels[i], labels[j], float(sim[i, j])) for i, j in itertools.combinations(range(len(x)), 2)]
    return sim, spark.createDataFrame(rows, "generator_a int, generator_b int, family_a long, family_b long, cosine double")


def delta(sim, a, b):
    pairs = [sim[i, j] for i, j in itertools.combinations(a, 2) if i != j]
    return np.mean(pairs) - sim[np.ix_(a, b)].mean() if pairs else None


def test_every_family_has_its_own_size_null_and_interval(spark):
    labels = [0, 1, 1, 1, 2, 2, 0, 2, 2, 3]  # sizes 2, 3, 4 and 1
    sim, table = pair_table(spark, np.random.default_rng(3).normal(size=(10, 6)) + np.eye(10, 6) * 2, labels)
    draws = tables.family_draws(spark, labels, 300, 5, most=130)
    got = {r.family: r for r in Q.family_tests(A.family_contrast(table, draws)).collect()}
    assert [(got[f].n, got[f].method, got[f].n_null) for f in range(4)] == [(2, "exact", 45), (3, "exact", 120), (4, "drawn", 300), (1, "exact", 10)]
    everything, want = np.arange(10), {}
    for f in range(3):
        inside, outside = np.flatnonzero(np.array(labels) == f), np.flatnonzero(np.array(labels) != f)
        k, rng = len(inside), np.random.default_rng(tables.seed_of("H4F_PERM", f, 5))
        subsets = list(map(list, itertools.combinations(range(10), k))) if k < 4 else [np.sort(rng.choice(everything, size=k, replace=False)) for _ in range(300)]
        seen = delta(sim, inside, outside)
        hits = sum(delta(sim, a, np.setdiff1d(everything, a)) >= seen - 1e-12 for a in subsets)
        want[f] = hits / len(subsets) if k < 4 else (1 + hits) / 301
        rng = np.random.default_rng(tables.seed_of("H4F_BOOT", f, 5))
        boot = [d for d in (delta(sim, rng.choice(inside, k), rng.choice(outside, 10 - k)) for _ in range(300)) if d is not None]
        assert got[f].delta == pytest.approx(seen) and got[f].p == pytest.approx(want[f]) and got[f].n_boot == len(boot)
        assert [got[f].low, got[f].high] == pytest.approx(np.quantile(boot, [0.025, 0.975]))
    order = sorted(want, key=want.get)
    running = 1.0
    for i in range(2, -1, -1):
        running = min(running, want[order[i]] * 3 / (i + 1))
        assert got[order[i]].q == pytest.approx(running)
    assert got[3].p is None and got[3].q is None and got[3].delta is None


def test_all_families_of_the_table(spark, sf_dir):
    rows = {r.family: r for r in Q.QUERIES["family_specific"](spark, sf_dir).collect()}
    single = {r.family: r.delta for r in Q.QUERIES["family_within_outside"](spark, sf_dir).collect()}
    assert sorted(rows) == [0, 1, 2, 3] and all(r.p >= 0 and r.q >= r.p and r.low <= r.high for r in rows.values())
    assert {r.n for r in rows.values()} == {2, 3} and {r.n_null for r in rows.values()} == {45, 120}
    assert all(r.within is not None and r.outside is not None for r in rows.values()) and set(single) == set(rows)


def oneway(x, labels):
    """Pseudo-F, R2 and dispersion F straight from centroids."""
    groups, n = np.unique(labels), len(x)
    centre = np.array([x[labels == labels[i]].mean(axis=0) for i in range(n)])
    total, within = ((x - x.mean(axis=0)) ** 2).sum(), ((x - centre) ** 2).sum()
    f = lambda b, w: (b / (len(groups) - 1)) / (w / (n - len(groups)))
    d = np.linalg.norm(x - centre, axis=1)
    own = np.array([d[labels == labels[i]].mean() for i in range(n)])
    return f(total - within, within), 1 - within / total, f(((own - d.mean()) ** 2).sum(), ((d - own) ** 2).sum())


def test_centroid_nulls_from_pairs(spark):
    labels = {i: v for i, v in enumerate([0, 0, 0, 1, 1, 1, 2, 2])}
    x, known = np.random.default_rng(8).normal(size=(8, 5)), np.array(list(labels.values()))
    d2 = spark.createDataFrame([(i, j, float(((x[i] - x[j]) ** 2).sum())) for i in range(8) for j in range(8)], "a long, b long, d2 double")
    plan = tables.label_permutations(spark, labels, 200, 42).unionByName(spark.createDataFrame([(-1, i, v) for i, v in labels.items()], "rep long, item long, label long"))
    draws = A.centroid_draws(d2, plan)
    rng = np.random.default_rng(42)
    null = np.array([oneway(x, known[rng.permutation(8)]) for _ in range(200)])
    got = {r.rep: (r.pseudo_f, r.r2, r.dispersion_f) for r in draws.collect()}
    assert np.array([got[i] for i in range(200)]) == pytest.approx(null) and got[-1] == pytest.approx(oneway(x, known))
    r = M.centroid_tests(draws).first()
    want = [(1 + (null[:, k] >= oneway(x, known)[k] - 1e-9).sum()) / 201 for k in range(3)]
    assert [r.p, r.p_r2, r.p_dispersion] == pytest.approx(want) and r.n_draws == 200


def test_centroid_query_agrees_with_the_observed_values(spark, sf_dir):
    r = M.centroid_permutation_null(spark, sf_dir).first()
    seen, spread = Q.QUERIES["pseudo_f"](spark, sf_dir).first(), Q.QUERIES["dispersion_f"](spark, sf_dir).first()
    assert r.n_draws == 5000 and (r.observed, r.r2, r.dispersion_f) == pytest.approx((seen.pseudo_f, seen.r2, spread.dispersion_f), abs=2e-6)


def test_h3b_nulls_against_numpy(spark):
    x = np.random.default_rng(4).normal(size=(2, 6, 7)) + np.linspace(0, 2, 7)
    profiles = spark.createDataFrame([(c, g, x[c, g].tolist()) for c in range(2) for g in range(6)], "ctx int, generator int, r array<double>")
    comparisons = [(0, 1, [0, 1], [0, 1, 2, 3, 4], [3, 0, 5], [0, 1, 3, 5]), (2, 1, [4], [0, 1, 2, 3, 4], [1], [0, 1, 3, 5])]
    got = {r.test: r for r in M.h3b_tests(A.subset_likeness(profiles, tables.paired_subsets(spark, comparisons, 400, 9))).collect()}
    rho = lambda a, b: np.corrcoef(np.median(x[0, a], axis=0), np.median(x[1, b], axis=0))[0, 1]
    want = {}
    for test, fam, ga, pa, gb, pb in comparisons:
        rng = np.random.default_rng(tables.seed_of("H3b_perm", test, fam, 9))
        null = [rho(np.array(pa)[rng.choice(len(pa), len(ga), replace=False)], np.array(pb)[rng.choice(len(pb), len(gb), replace=False)]) for _ in range(400)]
        want[test] = (1 + sum(v >= rho(ga, gb) - 1e-12 for v in null)) / 401
        assert (got[test].n_draws, got[test].observed, got[test].p) == (400, pytest.approx(rho(ga, gb)), pytest.approx(want[test]))
    first, last = sorted(want, key=want.get)
    assert got[first].p_holm == pytest.approx(min(1, 2 * want[first])) and got[last].p_holm == pytest.approx(min(1, max(2 * want[first], want[last])))


def test_h3b_takes_all_draws(spark, sf_dir):
    rows = M.h3b_table(spark, sf_dir).collect()
    assert rows and {r.n_draws for r in rows} == {10_000}


def test_logo_nulls_against_numpy(spark):
    labels = np.array([0, 0, 0, 1, 1, 1, 2, 2])
    z = np.random.default_rng(6).normal(size=(8, 8, 5)) + np.eye(3, 5)[labels] * 2  # fold, generator, bin
    z /= np.linalg.norm(z, axis=2, keepdims=True)
    arrays = spark.createDataFrame([(f, g, f == g, z[f, g].tolist()) for f in range(8) for g in range(8)], "fold int, generator int, held boolean, z array<double>")
    plan = tables.label_permutations(spark, {i: int(v) for i, v in enumerate(labels)}, 60, 44).selectExpr("rep", "cast(item as int) generator", "cast(label as int) family")
    plan = plan.unionByName(spark.createDataFrame([(-1, i, int(v)) for i, v in enumerate(labels)], "rep long, generator int, family int"))

    def scored(y):
        predicted = []
        for f in range(8):
            others, scores = np.arange(8) != f, []
            for c in range(3):
                p = np.median(z[f, others & (y == c)], axis=0)
                scores.append(z[f, f] @ p / np.linalg.norm(p))
            predicted.append(int(np.argmax(scores)))
        predicted, recall, f1 = np.array(predicted), [], []
        for c in range(3):
            hit, n, m = ((y == c) & (predicted == c)).sum(), (y == c).sum(), (predicted == c).sum()
            recall.append(hit / n)
            f1.append(2 * hit / (n + m))
        return np.mean(recall), np.mean(f1)

    scores = I.class_scores_by(A.logo_draws(arrays, plan), "true", "predicted", 3, "rep")
    rng = np.random.default_rng(44)
    null, seen = np.array([scored(labels[rng.permutation(8)]) for _ in range(60)]), scored(labels)
    got = {r.rep: (r.ba, r.f1) for r in scores.collect()}
    assert np.array([got[i] for i in range(60)]) == pytest.approx(null) and got[-1] == pytest.approx(seen)
    r = M.logo_tests(scores).first()
    assert (r.n_draws, r.p, r.p_macro_f1) == (60, *[pytest.approx((1 + (null[:, k] >= seen[k] - 1e-12).sum()) / 61) for k in range(2)])


def test_logo_query_agrees_with_the_observed_scores(spark, sf_dir):
    r, seen = M.logo_permutation_null(spark, sf_dir).first(), Q.QUERIES["logo_metrics"](spark, sf_dir).first()
    assert r.n_draws == 1000 and (r.observed, r.macro_f1) == pytest.approx((seen.balanced_accuracy, seen.macro_f1), abs=2e-6)
