import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomvec.operators import inference as I
from loomvec.plans import tables


def test_holm_and_bh(spark):
    p = spark.createDataFrame([(0, 0.01), (1, 0.03), (2, 0.04), (3, float("nan")), (4, None)], "i int, p double")
    holm = {r.i: r.h for r in I.holm(p, "p", "h").collect()}
    assert holm[0] == pytest.approx(0.03) and holm[1] == pytest.approx(0.06) and holm[2] == pytest.approx(0.06) and holm[3] is None and holm[4] is None
    bh = {r.i: r.b for r in I.benjamini_hochberg(p.where("i < 3"), "p", "b").collect()}
    assert bh == pytest.approx({0: 0.03, 1: 0.04, 2: 0.04})


def test_signflip(spark):
    v = spark.createDataFrame([(x,) for x in (0.5, 0.4, 0.3, 0.2, 0.1)], "v double")
    r = I.signflip_p(v, "v").first()
    assert (r.n, r.p) == (5, 1 / 32) and r.mean == pytest.approx(0.3)
    with pytest.raises(Exception, match="too many"):
        I.signflip_p(spark.range(21).select(F.col("id").alias("v")), "v").collect()


def test_wilcoxon_against_plain_ranks(spark):
    d = [3, -1, 2, 2, -2, 0, 5, 4, -1, 3]
    r = I.wilcoxon(spark.createDataFrame([("x", float(x)) for x in d], "k string, d double"), "d", "k").first()
    nz = np.array([x for x in d if x])
    a = np.abs(nz)
    ranks = np.array([(a < x).sum() + ((a == x).sum() + 1) / 2 for x in a])
    assert r.n == 9 and r.w_plus == pytest.approx(ranks[nz > 0].sum())
    assert I.wilcoxon(spark.createDataFrame([("x", 0.0)], "k string, d double"), "d", "k").collect() == []


def test_normal_tail(spark):
    zs = [-6.0, -2.5, -0.1, 0.0, 0.7, 2.99, 3.0, 5.0, 8.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select(I.normal_upper(F.col("z"))).collect()
    assert [r[0] for r in got] == pytest.approx([0.5 * math.erfc(z / math.sqrt(2)) for z in zs], rel=1e-6)


def test_class_scores_and_confusion(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "t string, p string")
    r = I.class_scores(df, "t", "p").first()
    assert r.accuracy == 0.5 and r.balanced_accuracy == pytest.approx((0.5 + 1 + 0) / 3) and r.macro_f1 == pytest.approx((0.5 + 2 / 3 + 0) / 3)
    table = {x.t: (x.pred_a, x.pred_b, x.pred_c) for x in I.confusion(df, "t", "p", ["a", "b", "c"]).collect()}
    assert table == {"a": (1, 1, 0), "b": (0, 1, 0), "c": (1, 0, 0)}


def test_upper_p(spark):
    null = spark.createDataFrame([(x,) for x in (0.1, 0.2, 0.3)], "x double")
    assert null.agg(I.upper_p(F.col("x"), F.lit(0.2))).first()[0] == pytest.approx(3 / 4)


def test_plans_replay_numpy(spark):
    rng = np.random.default_rng(7)
    want = [rng.permutation(5).tolist() for _ in range(3)]
    got = tables.permutations(spark, list(range(5)), 3, 7).orderBy("rep", "pos").collect()
    assert [[r.item for r in got if r.rep == k] for k in range(3)] == want
    assert tables.subsets(spark, list(range(6)), 3, 0, 1).select("rep").distinct().count() == 20
    labels = tables.label_permutations(spark, {1: 0, 2: 0, 3: 1}, 10, 3)
    assert {r.n for r in labels.groupBy("rep").agg(F.sum("label").alias("n")).collect()} == {1}
    drawn = tables.stratified_bootstraps(spark, {"x": [1, 2], "y": [3]}, 4, 5)
    assert drawn.where("stratum = 'y' and item <> 3").count() == 0 and drawn.count() == 12
