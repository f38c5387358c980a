import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomvec.functions import vectors as V

numbers = st.lists(st.floats(-100, 100, allow_nan=False).map(lambda x: round(x, 3)), min_size=6, max_size=6)


def row(spark, a, b, *columns):
    return spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(*columns).first()


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=numbers, b=numbers)
def test_as_numpy(spark, a, b):
    x, y = F.col("a"), F.col("b")
    got = row(spark, a, b, V.pearson(x, y), V.cosine(x, y), V.euclidean(x, y), V.rmse(x, y), V.mae(x, y), V.median(x), V.quantile(x, 0.9), V.top_bins(x, 0.4))
    na, nb = np.array(a), np.array(b)
    ca, cb = na - na.mean(), nb - nb.mean()
    size = np.linalg.norm(ca) * np.linalg.norm(cb)
    if size > 1e-6:
        assert got[0] == pytest.approx(ca @ cb / size, abs=1e-6)
    if np.linalg.norm(na) * np.linalg.norm(nb) > 1e-6:
        assert got[1] == pytest.approx(na @ nb / (np.linalg.norm(na) * np.linalg.norm(nb)), abs=1e-6)
    assert got[2:7] == pytest.approx((np.linalg.norm(na - nb), np.sqrt(((na - nb) ** 2).mean()), np.abs(na - nb).mean(), np.median(na), np.quantile(na, 0.9)), abs=1e-6)
    assert got[7] == np.argsort(-np.abs(na), kind="stable")[:3].tolist()


def test_degenerate_and_ties(spark):
    x, y = F.col("a"), F.col("b")
    got = row(spark, [1.0, 1.0, 1.0], [1.0, 2.0, 3.0], V.pearson(x, y), V.pearson(x, y, 0.0), V.top_bins(x, 0.34), V.average_ranks(x), V.l2_normalised(V.centred(x)))
    assert got[0] is None and got[1] == 0.0
    assert got[2] == [0, 1] and got[3] == [2.0, 2.0, 2.0] and got[4] == [0.0, 0.0, 0.0]


def test_signed_jaccard_and_wasserstein(spark):
    x, y = F.col("a"), F.col("b")
    hz = F.array(*[F.lit(float(10 * i)) for i in range(4)])
    got = row(spark, [5.0, -4.0, 0.0, 0.0], [5.0, 4.0, 0.0, 0.0], V.jaccard(V.threshold_bins(x, 0.5), V.threshold_bins(y, 0.5)), V.signed_jaccard(x, y, 0.5), V.wasserstein(x, y, hz))
    assert got[0] == 1.0 and got[1] == pytest.approx(1 / 2) and got[2] == pytest.approx(0.0)
    moved = row(spark, [1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 1.0], V.wasserstein(x, y, hz))
    assert moved[0] == pytest.approx(30.0)


def test_not_finite(spark):
    rows = spark.createDataFrame([([1.0],), ([float("nan")],), ([float("inf")],), ([None],)], "a array<double>")
    assert [r[0] for r in rows.select(V.is_finite(F.col("a"))).collect()] == [True, False, False, False]
