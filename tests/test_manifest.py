import pytest
from pyspark.sql import functions as F

from loomvec.functions import text as T
from loomvec.operators import analysis as A
from loomvec.operators import manifest as M
from loomvec.operators import profiles as P


def test_guards(spark):
    df = spark.createDataFrame([("a", 1, [1.0]), ("a", 2, [float("nan")])], "k string, v int, r array<double>")
    with pytest.raises(M.GuardError, match="missing columns: x"):
        M.require_columns(df, "x", "k")
    for broken in (lambda: M.unique_guard(df, "k"), lambda: M.dependency_guard(df, "k", "v"), lambda: M.finite_guard(df, "r"), lambda: M.population_guard(df, rows=3), lambda: M.subset_guard(df, df.where("v = 1"), "v"), lambda: M.nonempty_guard(df.withColumn("k", F.lit(" ")), "k")):
        with pytest.raises(M.GuardError):
            broken()
    assert M.population_guard(M.unique_guard(df, "v"), rows=2, k=1) is df
    assert M.first_column(df, "none", "v") == "v"


def test_sequential_hash_audit(spark):
    rows = [(1, "o1", "g1", "A", "R1"), (2, "o2", "g1", "A", "R2"), (3, "o1", "g2", "B", "R3"), (4, "o3", "g2", "C", "R3"), (5, "o5", "g3", "R6", "R5"), (6, "o6", "g3", "D", "R6"), (7, "o7", "g1", None, None)]
    df = spark.createDataFrame([(*r, "ok", "") for r in rows], "id int, original_id string, generator string, fake_sha256 string, real_sha256 string, qc_status string, exclusion_reason string")
    out, audit = M.hash_audit(df)
    found = {r.id: r.exclusion_reason for r in out.collect()}
    assert found == {1: "ambiguous_fake_hash_duplicate", 2: "ambiguous_fake_hash_duplicate", 3: "ambiguous_real_hash_duplicate", 4: "ambiguous_real_hash_duplicate", 5: "fake_real_hash_collision", 6: "", 7: ""}
    assert sorted((r.audit_type, r.sha256) for r in audit.collect()) == [("ambiguous_fake_hash", "A"), ("ambiguous_real_hash", "R3"), ("fake_real_hash_collision", "R6")]


def test_mismatch_has_no_fixed_point(spark):
    df = spark.createDataFrame([("s1", 1), ("s1", 5), ("s2", 3), ("s3", 9)], "speaker string, o int")
    got = {r.o: r.partner for r in M.mismatch(df, "o", "speaker").collect()}
    assert got == {1: 5, 5: 1, 3: 5, 9: 1}
    hashed = M.hashed_rotation(df, "o", "x", "speaker").collect()
    assert {r.o: r.partner for r in hashed} == {1: 5, 5: 1}


def test_paths(spark):
    files = spark.createDataFrame([("a/x/1.wav",), ("a/y/2.wav",), ("a/z/2.wav",), ("b.wav",)], "path string")
    wanted = spark.createDataFrame([("a/1.wav",), ("a/2.wav",), ("b.wav",), ("c/3.wav",)], "path string")
    got = {r.path: (r.resolved, r.method) for r in M.resolve_paths(wanted, files).collect()}
    assert got == {"a/1.wav": ("a/x/1.wav", "inserted_second_level_unique"), "a/2.wav": ("a/2.wav", "ambiguous_multiple_matches"), "b.wav": ("b.wav", "direct"), "c/3.wav": ("c/3.wav", "not_found")}


def test_text_rules(spark):
    df = spark.createDataFrame([("a;b", "x_generated", ".//a/by_book/anna/1.wav", " N/A "), (None, "y_gen", "q", "ABC")], "r string, s string, p string, h string")
    got = df.select(T.append_reason(F.col("r"), "b"), T.strip_suffix(F.col("s")), T.speaker_from_path(F.col("p")), T.clean_path(F.col("p")), T.clean_hash(F.col("h")), T.speaker_prefix(F.col("s")), T.reason_tokens(F.col("r")), T.family_label(F.lit("GAN"))).collect()
    assert tuple(got[0]) == ("a;b", "x", "anna", "a/by_book/anna/1.wav", None, "x", ["a", "b"], "GAN vocoder")
    assert tuple(got[1])[:6] == ("b", "y", "unknown", "q", "abc", "y")


def test_language_reference_needs_two_others(spark):
    cells = spark.createDataFrame([(g, "f", lang, 0, float(v), 1) for g, lang, v in [(1, "en", 1), (2, "en", 2), (3, "en", 6), (1, "de", 5), (2, "de", 7)]], "generator int, family string, language string, bin int, v double, n_pairs long")
    got = {(r.generator, r.language): r.ref for r in P.language_reference(cells).collect()}
    assert got == {(1, "en"): 4.0, (2, "en"): 3.5, (3, "en"): 1.5}


def test_framing_pads_and_drops_the_rest(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [float(i) for i in range(7)])], "k string, s array<double>")
    got = sorted((r.k, r.frame, r.x) for r in A.framed(df, "s", 4, 2, "k").collect())
    assert got == [("a", 0, [1.0, 2.0, 0.0, 0.0]), ("b", 0, [0.0, 1.0, 2.0, 3.0]), ("b", 1, [2.0, 3.0, 4.0, 5.0])]
