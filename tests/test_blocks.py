"""Content blocks, redraws and split halves against plain NumPy."""

import hashlib

import numpy as np
import pytest

from loomvec import queries as Q
from loomvec import queries_more as M
from loomvec.operators import analysis as A
from loomvec.plans import tables


def test_blocks_follow_the_number_of_rows(spark):
    sizes, rows = {0: 5, 1: 30, 2: 260}, []
    for g, n in sizes.items():
        rows += [(1000 * g + i, g, [float(i), float(i * i % 17)]) for i in range(n)]
    got = {(r.generator, r.block, r.bin): (r.n_blocks, r.v) for r in Q.cell_blocks(spark.createDataFrame(rows, "vec_id long, generator int, embedding array<double>")).collect()}
    for g, n in sizes.items():
        blocks = {0: 4, 1: 7, 2: 50}[g]
        seed = lambda r: int(hashlib.sha256(f"BLOCK||{g}||{r[0]}".encode()).hexdigest()[:16], 16) % (2**32 - 1)  # noqa: B023, E731
        line = sorted((r for r in rows if r[1] == g), key=lambda r: (seed(r), r[0]))
        assert len([k for k in got if k[0] == g]) == 2 * blocks
        for b in range(blocks):
            want = np.median([r[2] for r in line[b::blocks]], axis=0)
            assert [got[g, b, k] for k in range(2)] == [(blocks, v) for v in want]


def test_redraws_and_halves_against_numpy(spark):
    x = {0: np.random.default_rng(1).normal(size=(4, 6)), 1: np.random.default_rng(2).normal(size=(7, 6)) + np.arange(6)}
    rows = [(g, len(m), b, k, float(m[b, k])) for g, m in x.items() for b in range(len(m)) for k in range(6)]
    blocks = spark.createDataFrame(rows, "generator int, n_blocks int, block int, bin int, v double")
    got = {(r.generator, r.rep): (r.rho, r.rmse) for r in A.redrawn_blocks(blocks, tables.block_draws(spark, [4, 7], 20, [5, 6, 7], replace=True)).collect()}
    assert len(got) == 2 * 60
    for g, m in x.items():
        for s, seed in enumerate((5, 6, 7)):
            rng = np.random.default_rng(seed)
            for rep in range(20):
                r, full = np.median(m[rng.choice(len(m), len(m))], axis=0), np.median(m, axis=0)
                assert got[g, 20 * s + rep] == pytest.approx((np.corrcoef(r, full)[0, 1], np.sqrt(((r - full) ** 2).mean())))
    halves = {r.rep: (r.delta, r.least_same) for r in A.split_halves(blocks, tables.block_draws(spark, [4, 7], 10, [7], replace=False)).collect()}
    order = {n: np.random.default_rng(7) for n in (4, 7)}
    for rep in range(10):
        p = {g: order[len(m)].permutation(len(m)) for g, m in x.items()}
        a, b = ({g: np.median(x[g][p[g][: len(p[g]) // 2] if first else p[g][len(p[g]) // 2 :]], axis=0) for g in x} for first in (True, False))
        rho = {(g, h): np.corrcoef(a[g], b[h])[0, 1] for g in x for h in x}
        assert halves[rep] == pytest.approx(((rho[0, 0] + rho[1, 1] - rho[0, 1] - rho[1, 0]) / 2, min(rho[0, 0], rho[1, 1])))


def test_all_redraws_of_all_seeds(spark, sf_dir):
    assert {r.n for r in M.block_bootstrap(spark, sf_dir).collect()} == {1500}
