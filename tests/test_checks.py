"""Raising guards, assembly rules, and draws against plain NumPy."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomvec import queries as Q
from loomvec import queries_checks
from loomvec.operators import analysis as A
from loomvec.operators import checks as C
from loomvec.operators import inference as I
from loomvec.operators import manifest as M
from loomvec.operators import profiles as P
from loomvec.plans import tables
from loomvec.session import setting


def test_p_values_are_guarded(spark):
    p = spark.createDataFrame([(0, 0.02), (1, 0.04), (2, None), (3, float("nan"))], "i int, p double")
    assert {r.i: r.b for r in I.benjamini_hochberg(p, "p", "b").collect()} == {0: pytest.approx(0.04), 1: pytest.approx(0.04), 2: None, 3: None}
    for bad in (None, float("nan"), 1.5, -0.1):
        with pytest.raises(Exception, match="not a p-value"):
            I.holm(I.valid_p(spark.createDataFrame([(0, 0.1), (1, bad)], "i int, p double"), "p"), "p", "h").collect()
    assert I.valid_p(p.where("i < 2"), "p").count() == 2


def test_references_raise_or_fall_back(spark):
    rows = [(1, "en", 1), (2, "en", 2), (3, "en", 6), (1, "de", 5), (2, "de", 7)]
    cells = spark.createDataFrame([(g, lang, 0, float(v)) for g, lang, v in rows], "generator int, language string, bin int, v double")
    with pytest.raises(Exception, match="too few other generators"):
        P.language_reference(cells, short="raise").collect()
    assert P.language_reference(cells.where("language = 'en'"), short="raise").count() == 3
    got = {(r.generator, r.language): (r.ref, r.n_reference) for r in P.language_reference(cells, short="global").collect()}
    assert got[1, "de"] == (np.median([2, 6, 7]), 1) and got[2, "de"] == (np.median([1, 6, 5]), 1) and got[1, "en"] == (4.0, 2)
    with pytest.raises(ValueError):
        P.language_reference(cells, short="x")


def test_guards_raise(spark, tmp_path):
    df = spark.createDataFrame([(1, "ok", "g", "f", [1.0, 2.0]), (2, "ok", "h", "f", [1.0, 3.0])], "k int, status string, g string, f string, r array<double>")
    path = str(tmp_path / "t")
    rules = C.TableRules("k", "status", ("g", "f"), "r", 2, ("g", "f"), {"rows": 2, "g": 2})

    def load(table, rules=rules):
        table.write.mode("overwrite").parquet(path)
        return C.guarded(spark, path, rules)

    assert load(df.withColumn("g", F.concat(F.lit(" "), "g"))).select("g").distinct().count() == 2
    second = F.col("k") == 2
    broken = [
        df.drop("f"), df.withColumn("k", F.lit(1)), df.withColumn("status", F.when(second, "fail").otherwise("ok")), df.withColumn("status", F.when(second, None).otherwise("ok")), df.withColumn("g", F.when(second, " ").otherwise("g")),
        df.withColumn("r", F.when(second, F.array(F.lit(1.0))).otherwise(F.col("r"))), df.withColumn("r", F.when(second, F.array(F.lit(1.0), F.lit(float("nan")))).otherwise(F.col("r"))), df.withColumn("r", F.when(~second, F.col("r"))), df.where("k = 1"),
        df.withColumn("g", F.lit("g")).withColumn("f", F.when(second, "x").otherwise("f")),
    ]
    for table in broken:
        with pytest.raises(M.GuardError):
            load(table)
    with pytest.raises(M.GuardError):
        C.success_guard(df.withColumn("status", F.when(second, "fail").otherwise("ok")))
    with pytest.raises(M.GuardError):
        C.success_guard(df.where("false"), 0.5)
    assert C.success_guard(df) is df
    (tmp_path / "here").write_text("x")
    files = spark.createDataFrame([(str(tmp_path / "here"),)], "p string")
    assert C.paths_guard(files, "p") is files
    with pytest.raises(M.GuardError, match="1 paths"):
        C.paths_guard(files.unionByName(spark.createDataFrame([(str(tmp_path / "gone"),)], "p string")), "p")
    with pytest.raises(M.GuardError):
        C.matched_guard(spark.createDataFrame([("a", None)], "k string, d string"), "k", "d")
    with pytest.raises(M.GuardError):
        C.language_guard(spark.createDataFrame([(None, "en", "a.wav")], "language string, lang_folder string, path string"))
    good = spark.createDataFrame([("o1", "g", "A", "B"), ("o2", "g", "C", "D")], "original_id string, generator string, fake_sha256 string, real_sha256 string")
    C.hash_guard(good)
    for row in (("o3", "g", "A", "E"), ("o3", "h", "F", "B"), ("o3", "g", "B", "G")):
        with pytest.raises(M.GuardError):
            C.hash_guard(good.unionByName(spark.createDataFrame([row], good.schema)))
    with pytest.raises(M.GuardError):
        C.numeric_guard(df, df.withColumn("r", F.transform("r", lambda x: x + 0.1)), "k", "r")
    assert C.numeric_guard(df, df, "k", "r") is df
    short = C.numeric_differences(df, df.withColumn("r", F.slice("r", 1, 1)), "k", "r").collect()
    assert not any(r.ok for r in short)


def test_assembly(spark):
    candidates = spark.createDataFrame([("p1", "f1", "r1"), ("p2", "f2", "r1"), ("p3", "f9", "r1"), ("p4", "f3", "r1")], "pair_id string, fake_path string, real_path string")
    measured = spark.createDataFrame([("f1", "A", 1.0, "ok", ""), ("f2", "B", 9.0, "fail", "too_long;clipping"), ("r1", "C", 1.2, "ok", ""), ("f3", "D", 1.0, "fail", "")], "path string, sha256 string, duration double, qc_status string, exclusion_reason string")
    got = {r.pair_id: (r.qc_status, r.exclusion_reason) for r in C.manifest_rows(candidates, measured).collect()}
    assert got == {"p1": ("ok", ""), "p2": ("fail", "fake:too_long;fake:clipping;duration_ratio_out_of_bounds"), "p3": ("fail", "fake:missing"), "p4": ("fail", "side_failed")}
    assert C.chunk_ranges(7, 3) == [(0, 3), (3, 6), (6, 7)] and C.chunk_ranges(0, 3) == []
    with pytest.raises(ValueError):
        C.chunk_ranges(1, 0)
    pairs = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    named = spark.createDataFrame([(1, "a"), (1, "a"), (2, " ")], "k int, speaker_id string")
    assert {r.k: r.speaker_id for r in C.speaker_of(pairs, named, "k").collect()} == {1: "a", 2: "unknown", 3: "unknown"}
    assert {r.speaker_id for r in C.speaker_of(pairs, named.drop("speaker_id"), "k").collect()} == {"unknown"}


def shuffles(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


def test_assembly_shuffles_candidates_once(spark, sf_dir):
    candidates = spark.createDataFrame([(f"p{i}", f"f{i % 70}" if i % 9 else None, f"r{i % 4}") for i in range(500)], "pair_id string, fake_path string, real_path string")
    kind = "path string, sha256 string, duration double, qc_status string, exclusion_reason string"
    fakes = spark.createDataFrame([(f"f{i}", f"A{i}", float(i), "ok" if i % 3 else "fail", "" if i % 3 else "clipping") for i in range(60)], kind)
    reals = spark.createDataFrame([("r0", "B0", 9.0, "ok", ""), ("r1", None, None, None, None), ("r2", "B2", 30.0, "fail", "too_long;silence")], kind)
    plain = C.manifest_rows(candidates, fakes.unionByName(reals))
    want = sorted(map(str, plain.collect()))
    assert len(want) == 500
    seen = {}
    for most, (a, b) in ((1 << 20, (fakes, reals)), (1000, (fakes, reals)), (0, (fakes, reals)), (1000, (reals, fakes))):
        turned = a is reals
        pairs = candidates.select("pair_id", F.col("real_path").alias("fake_path"), F.col("fake_path").alias("real_path")) if turned else candidates
        made = C.manifest_rows(pairs, a, real_measured=b, broadcast_bytes=most)
        seen[most, turned] = len(shuffles(made))
        assert sorted(map(str, made.collect())) == (sorted(map(str, C.manifest_rows(pairs, fakes.unionByName(reals)).collect())) if turned else want)
        assert made.columns == plain.columns
    assert seen == {(1 << 20, False): 0, (1000, False): 2, (0, False): 4, (1000, True): 2}  # the candidates and the files of a join
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        assert shuffles(queries_checks.manifest_assembly(spark, sf_dir)) == []


def test_ranks_over_hot_and_null_groups(spark):
    rows = [("hot", i * 7 % 501) for i in range(501)] + [(None, i) for i in range(20)] + [("one", 5)]
    got = M.ranked(spark.createDataFrame(rows, "g string, v int").repartition(5), ["g"], ["v"]).collect()
    assert len(got) == len(rows)
    for g in ("hot", None, "one"):
        own = sorted((r._rank, r.v, r._n) for r in got if r.g == g)
        values = sorted(v for k, v in rows if k == g)
        assert own == [(i, v, len(values)) for i, v in enumerate(values)]
    partner = {(r.g, r.v): r.partner for r in M.rotated(spark.createDataFrame(rows, "g string, v int"), "v", "g").collect()}
    assert partner["hot", 500] == 0 and partner["hot", 3] == 4 and partner[None, 19] == 0 and partner["one", 5] == 5


def test_sampled_sign_flips(spark):
    v = np.random.default_rng(3).normal(0.3, 1, 25)
    values = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)] + [(99, float("nan"))], "pos int, x double")
    plan = tables.sign_draws(spark, 25, 400, 11)
    rng = np.random.default_rng(11)
    hits = sum(np.mean(v * rng.choice([-1.0, 1.0], size=25)) >= v.mean() - 1e-15 for _ in range(400))
    got = I.signflip_sampled(values, "x", plan).first()
    assert (got.n, got.p) == (25, pytest.approx((hits + 1) / 401))


def test_exact_ranks_against_enumeration(spark):
    rng = np.random.default_rng(4)
    groups = {f"g{n}": rng.normal(0.3, 1, n) for n in (1, 2, 5, 9, 12)}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("tied", 1.0), ("tied", -1.0), ("tied", 2.0), *[("long", float(i + 0.5) * (-1) ** (i % 3)) for i in range(60)]]
    got = {r.g: r for r in I.wilcoxon_p(I.wilcoxon(spark.createDataFrame(rows, "g string, d double"), "d", "g")).collect()}
    for g, v in groups.items():
        ranks = np.argsort(np.argsort(np.abs(v))) + 1
        w = ranks[v > 0].sum()
        every = [sum(r for r, on in zip(ranks, signs, strict=True) if on) for signs in itertools.product([0, 1], repeat=len(v))]
        assert got[g].method == "exact" and got[g].p == pytest.approx(np.mean([x >= w for x in every]))
    assert got["tied"].method == got["long"].method == "normal" and got["long"].p == pytest.approx(0.5 * math.erfc(got["long"].z / math.sqrt(2)))


def test_capped_draw_falls_back(spark):
    groups = {"b": list(range(100, 120)), "a": list(range(5))}
    rng = np.random.default_rng(7 + 17)
    pool = [groups["a"][i] for i in rng.choice(5, size=3, replace=False)] + [groups["b"][i] for i in rng.choice(20, size=3, replace=False)]
    want = [pool[i] for i in rng.choice(6, size=4, replace=False)]
    assert [r.item for r in tables.capped_draw(spark, groups, 3, 4, 7).orderBy("pos").collect()] == want
    assert {r.item for r in tables.capped_draw(spark, groups, 3, 25, 7).collect()} == {*groups["a"], *groups["b"]}
    with pytest.raises(ValueError):
        tables.capped_draw(spark, groups, 3, 26, 7)


def test_redrawn_rows_against_numpy(spark):
    data = {(t, s): np.random.default_rng(10 * t + s).normal(size=(6 + t + s, 5)) for t in (1, 2) for s in (0, 1)}
    rows = [(t, s, i, [float(x) for x in r]) for (t, s), m in data.items() for i, r in enumerate(m)] + [(3, 0, 0, [0.0] * 5)]
    got = {(r.tag, r.side, r.rep): r.r for r in A.redrawn_rows(spark.createDataFrame(rows, "tag int, side int, item int, embedding array<double>"), 15, 5).collect()}
    assert len(got) == 2 * 2 * 15
    for t in (1, 2):
        rng = np.random.default_rng(tables.seed_of("content_boot", t, 5))
        for rep in range(15):
            for s in (0, 1):
                m = data[t, s]
                assert got[str(t), s, rep] == pytest.approx(np.median(m[rng.choice(len(m), len(m))], axis=0))


def effects(spark, sf_dir):
    rows = Q.h2_effects(spark, sf_dir).orderBy("generator").collect()
    return [r["generator"] for r in rows], np.array([r["shape_effect"] for r in rows]), np.array([r["support_effect"] for r in rows])


def test_language_bootstrap_against_numpy(spark, sf_dir):
    ids, shape, support = effects(spark, sf_dir)
    rng = np.random.default_rng(20260)
    picks = np.array([rng.choice(len(ids), size=len(ids), replace=True) for _ in range(10_000)])
    got = Q.QUERIES["h2_bootstrap"](spark, sf_dir).first()
    want = [*np.quantile(shape[picks].mean(axis=1), [0.025, 0.975]), *np.quantile(support[picks].mean(axis=1), [0.025, 0.975])]
    assert (got.n_boot, [got.shape_low, got.shape_high, got.support_low, got.support_high]) == (10_000, pytest.approx(want, abs=2e-6))


def pair_matrix(spark, sf_dir):
    table = Q.similarity(spark, sf_dir).collect()
    family = {r.generator_a: r.family_a for r in table} | {r.generator_b: r.family_b for r in table}
    ids = sorted(family)
    sim = np.eye(len(ids))
    for r in table:
        i, j = ids.index(r.generator_a), ids.index(r.generator_b)
        sim[i, j] = sim[j, i] = r.cosine
    return ids, np.array([family[i] for i in ids]), sim


def contrast(sim, labels, picks):
    pairs = [(sim[a, b], labels[a] == labels[b]) for a, b in itertools.combinations(picks, 2) if a != b]
    same, other = [x for x, s in pairs if s], [x for x, s in pairs if not s]
    return np.mean(same) - np.mean(other) if same and other else None


def test_family_draws_against_numpy(spark, sf_dir):
    ids, labels, sim = pair_matrix(spark, sf_dir)
    everything = range(len(ids))
    observed = contrast(sim, labels, everything)
    rng = np.random.default_rng(42)
    null = np.array([contrast(sim, rng.permutation(labels), everything) for _ in range(5000)])
    got = Q.QUERIES["family_permutation_null"](spark, sf_dir).first()
    assert got.n_draws == 5000 and got.observed == pytest.approx(observed, abs=2e-6) and got.p == pytest.approx((1 + (null >= observed - 1e-12).sum()) / 5001, abs=2 / 5001)
    rng = np.random.default_rng(43)
    strata = {f: [i for i in everything if labels[i] == f] for f in sorted(set(labels))}
    boot = []
    for _ in range(2000):
        drawn = [x for f in strata for x in np.array(strata[f])[rng.choice(len(strata[f]), size=len(strata[f]), replace=True)]]
        boot.append(contrast(sim, labels, drawn))
    boot = [b for b in boot if b is not None]
    got = Q.QUERIES["family_stratified_bootstrap"](spark, sf_dir).first()
    assert got.n_draws == len(boot) and [got.low, got.high] == pytest.approx(np.quantile(boot, [0.025, 0.975]), abs=2e-6)


def test_medians_in_passes(spark):
    rng = np.random.default_rng(9)
    rows = [(g, b, float(v)) for g, n in (("a", 4001), ("b", 2), ("c", 1), ("d", 600)) for b in range(2) for v in (rng.normal(size=n) ** 3 if g != "d" else rng.integers(0, 3, n))]
    long = spark.createDataFrame(rows, "g string, bin int, v double").repartition(5)
    want = {(r.g, r.bin): (r.v, r.n_pairs) for r in P.bin_medians(long, "g").collect()}
    got = {(r.g, r.bin): (r.v, r.n_pairs) for r in P.large_medians(long, "g").collect()}
    assert got == want and len(got) == 8
