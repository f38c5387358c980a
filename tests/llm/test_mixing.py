import math
import random

import numpy as np
import pytest

from loomvec.llm import mixing
from tests.llm.brute import WORD

SCHEMA = "doc_id long, text string, source string"


def targets(sizes: dict) -> dict:
    """The rule step by step: share by weight, stop at twice the size, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    out, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), list(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            for s in open_:
                out[s] = left * weight[s] / total
            return out
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def check(rows, got, slack):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    want, taken = targets(sizes), dict.fromkeys(sizes, 0)
    by_id = {d: (len(WORD.findall(t or "")), s) for d, t, s in rows}
    for r in got:
        size, source = by_id[r.doc_id]
        assert r.size == size and r.source_size == sizes[source] and r.target == pytest.approx(want[source])
        assert 0 <= r.taken <= 2 * size and r.taken == r.copies * size
        taken[source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= slack(s), (s, taken[s], want[s])


def dual_solution(rows, ridge=mixing.RIDGE, cap=2.0):
    """Rates of all documents by plain Newton steps on the whole dual, document by document."""
    size = np.array([len(WORD.findall(t or "")) for _, t, _ in rows], float)
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    own = np.array([names.index(s) for _, _, s in rows])
    total = {s: int(size[own == i].sum()) for i, s in enumerate(names)}
    want = np.array([targets(total)[s] for s in names])
    kept = [int(n) >> max(0, int(n).bit_length() - 7) << max(0, int(n).bit_length() - 7) for n in size]
    log = np.log(np.maximum(kept, 1))
    mean = (size * log).sum() / size.sum()
    spread = math.sqrt((size * (log - mean) ** 2).sum() / size.sum())
    z = (log - mean) / spread
    x = np.stack([z, z * z - 1], axis=1)
    full = want >= cap * np.array([total[s] for s in names]) * (1 - 1e-12)
    none = want <= 0
    free = ~full & ~none
    theta = np.concatenate([[math.log(want[i] / total[s]) if free[i] else 0.0 for i, s in enumerate(names)], [0.0, 0.0]])
    features = np.concatenate([(own[:, None] == np.arange(len(names))) * free, x], axis=1).astype(float)
    goal = np.concatenate([want * free, [0.0, 0.0]])
    words, steady = want.sum(), np.concatenate([np.zeros(len(names)), [ridge, ridge]])

    def rates(at):
        tilt = features @ at
        return np.where(none[own], 0.0, np.where(full[own], cap, np.minimum(cap, np.exp(np.minimum(tilt, 5))))), tilt

    def value(at):
        r, tilt = rates(at)
        inner = np.where(full[own], cap * (x @ at[-2:]), np.where(tilt < math.log(cap), r, cap * (1 + tilt - math.log(cap))))
        return (size * np.where(none[own], 0, inner)).sum() - goal @ at + words * (steady * at**2).sum() / 2

    for _ in range(200):
        r, tilt = rates(theta)
        grad = features.T @ (size * r) - goal + words * steady * theta
        if np.abs(grad).max() < 1e-8 * words:
            return r, theta
        bend = size * r * (free[own] & (tilt < math.log(cap)))
        hess = (features * bend[:, None]).T @ features + np.diag(words * steady + 1e-9 * words)
        step, t = -np.linalg.solve(hess, grad), 1.0
        while value(theta + t * step) > value(theta) + 1e-12 * words and t > 1e-9:
            t /= 2
        theta = theta + t * step
    raise AssertionError("the plain dual did not settle")


def mixed_rows():
    rng = random.Random(7)
    long = {"a": 1.0, "b": 2.0, "c": 0.5, "d": 1.5, None: 0.8}
    return [(i, "w " * min(900, int(20 * rng.lognormvariate(1, 0.8) * long[s]) + 1), s) for i in range(700) for s in [rng.choice(["a", "b", "b", "b", "c", "c", "d", None])]]


def test_multipliers_as_the_whole_dual(spark):
    rows = mixed_rows()
    rate, theta = dual_solution(rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    slim = docs.select("source", mixing.word_count(docs["text"]).alias("size")).selectExpr("source", "size").withColumn("c", mixing.size_class(mixing.F.col("size")))
    cells = mixing.with_features(slim.groupBy("source", "c").agg(mixing.F.count("*").alias("n"), mixing.F.sum("size").alias("words")))
    sources = cells.withColumn("w", mixing.F.col("words")).groupBy("source").agg(mixing.F.sum("words").alias("source_size"), mixing.F.collect_list(mixing.F.struct("c", "n", "w", "z", "q")).alias("cells"))
    goals = mixing.source_targets(sources.select("source", "source_size")).withColumnRenamed("source", "of").drop("source_size")
    solved, beta = mixing.balance(sources.join(goals, mixing.F.col("source").eqNullSafe(mixing.F.col("of"))).drop("of"))
    assert beta == pytest.approx(theta[-2:], abs=1e-4) and max(abs(b) for b in beta) > 1e-3
    got = {r.source: r for r in solved.collect()}
    for i, s in enumerate(["a", "b", "c", "d", None]):
        assert (got[s].fixed is None) == (theta[i] != 0.0) and (got[s].fixed is not None or got[s].multiplier == pytest.approx(theta[i], abs=1e-4))
    # Copies stand for rates: by size class, and so also over the lengths.
    mixed = {r.doc_id: r for r in mixing.mix(docs).collect()}
    sizes = np.array([mixed[i].size for i in range(len(rows))])
    for low, high in ((1, 40), (40, 80), (80, 160), (160, 1000)):
        pick = (sizes >= low) & (sizes < high)
        taken = sum(mixed[i].taken for i in np.flatnonzero(pick))
        assert taken == pytest.approx((sizes * rate)[pick].sum(), rel=0.06)


@pytest.mark.parametrize("bucket_rows", [4, 1 << 14])
def test_targets_are_met(spark, bucket_rows):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(1, 400), rng.choice(["b", "a", "ä", "A", None, "b", "b", "b"])) for i in range(900)]
    rows += [(1000 + i, "same text here", "b") for i in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), bucket_rows=bucket_rows).collect()
    assert len(got) == len(rows)
    check(rows, got, lambda s: 400)
    again = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(7), bucket_rows=bucket_rows).collect()
    assert sorted(got) == sorted(again)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check([tuple(r) for r in docs.select("doc_id", "text", "source").collect()], mixing.mix(docs).collect(), lambda s: 2000)


def test_defined_cases(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "a\x0bb\u00a0c", None), (4, "a b c d", "x")]
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[4].target == pytest.approx(5.4) and got[3].target == pytest.approx(3.6)
    assert got[3].size == 2 and got[1].size == 0 and got[1].taken == 0 and got[2].target == 0.0
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    kept = mixing.mix(spark.createDataFrame([(*r, 9) for r in rows], SCHEMA + ", size long"), keep=True)
    assert kept.columns == ["doc_id", "text", "source", "size", "copies"] and kept.count() == 4


def test_clashing_names(spark):
    names = ["target", "source_size", "base", "c", "n", "size", "bucket", "rank", "row", "mark", "p_c", "offset", "copies"]
    rows = [(i, "w " * (i % 9 + 1), "s" if i % 3 else None, *[str(i)] * len(names)) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA + ", " + ", ".join(f"{n} string" for n in names))
    got = mixing.mix(docs, keep=True, bucket_rows=4)
    assert got.columns == docs.columns and dict(got.dtypes)["copies"] == "bigint"
    assert sorted(tuple(r)[:-1] for r in got.collect()) == sorted(r[:-1] for r in rows)


def test_equal_and_null_ids(spark):
    rows = [(None, "a b c " * (i % 5 + 1), "s") for i in range(300)] + [(1, f"x{i} y z", "t") for i in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), bucket_rows=16).collect()
    assert len(got) == 600 and all(r.taken <= 2 * r.size for r in got)
    taken = {s: sum(r.taken for r in got if (r.doc_id is None) == (s == "s")) for s in "st"}
    want = targets({"s": sum(len(t.split()) for _, t, s in rows if s == "s"), "t": 900})
    assert all(abs(taken[s] - want[s]) <= 15 for s in "st")


def test_native(spark, sf_dir):
    plan = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
