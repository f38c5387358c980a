"""Guards that raise, and the assembly of manifests from candidates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomvec.functions.hashing import seed_be4
from loomvec.functions.text import append_reason
from loomvec.functions.vectors import is_finite
from loomvec.operators import manifest as M

#: Bytes of measured files that are broadcast at most; beyond that a shuffle join is used.
BROADCAST_BYTES = 48 << 20


def matched_guard(df: DataFrame, key: str, found: str) -> DataFrame:
    """After a left join: every row must have found its dimension."""
    M.expect_none(df.where(F.col(found).isNull()).select(key).distinct(), f"{key} without {found}")
    return df


def language_guard(meta: DataFrame) -> DataFrame:
    """A meta file's language must be its folder's."""
    wrong = meta.where(F.coalesce(F.lower(F.trim("language")), F.lit("")) != F.lower("lang_folder"))
    M.expect_none(wrong.select("language", "lang_folder", "path"), "language isn't the folder's")
    return meta


def success_rate(df: DataFrame, status: str = "status") -> DataFrame:
    """(n, n_ok, share) of a measured table; no rows count as no success."""
    ok = F.count_if(F.lower(F.trim(status)) == "ok")
    return df.agg(F.count("*").alias("n"), ok.alias("n_ok"), F.coalesce(ok / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("share"))


def success_guard(df: DataFrame, least: float = 1.0, status: str = "status") -> DataFrame:
    got = success_rate(df, status).first()
    if got["share"] < least:
        raise M.GuardError(f"{got['n_ok']} of {got['n']} rows are ok; {least:.2%} must be")
    return df


def path_sample(df: DataFrame, path: str, n: int = 80, seed: int = 0) -> DataFrame:
    """``n`` distinct paths by a seeded hash order: the same ones wherever and however the table is read."""
    return df.select(F.col(path).alias("path")).where("path is not null").distinct().orderBy(seed_be4(F.col("path"), F.lit(seed)), "path").limit(n)


def paths_guard(df: DataFrame, *paths: str, n: int = 80, seed: int = 0) -> DataFrame:
    """A sample of each path column must exist in its store."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    gone = []
    for column in paths:
        for row in path_sample(df, column, n, seed).collect():  # n rows at most
            place = jvm.org.apache.hadoop.fs.Path(row["path"])
            if not place.getFileSystem(conf).exists(place):
                gone.append(row["path"])
    if gone:
        raise M.GuardError(f"{len(gone)} paths are missing: {gone[:20]}")
    return df


def collisions(df: DataFrame) -> DataFrame:
    """(kind, sha256, n_rows): fake hashes across originals or generators, real hashes across originals, fake hashes that are real ones."""
    fake = M.hash_groups(df, "fake_sha256", "original_id", "generator").where("n_original_ids > 1 or n_generators > 1")
    real = M.hash_groups(df, "real_sha256", "original_id", "generator").where("n_original_ids > 1")
    known = df.select(F.col("real_sha256").alias("fake_sha256")).where("fake_sha256 is not null").distinct()
    both = df.join(known, "fake_sha256", "left_semi").groupBy(F.col("fake_sha256").alias("sha256")).agg(F.count("*").alias("n_rows"))
    parts = [("fake", fake), ("real", real), ("fake_is_real", both)]
    named = [rows.select(F.lit(kind).alias("kind"), "sha256", "n_rows") for kind, rows in parts]
    return named[0].unionByName(named[1]).unionByName(named[2])


def hash_guard(df: DataFrame) -> DataFrame:
    M.expect_none(collisions(df).orderBy("kind", "sha256"), "colliding hashes")
    return df


def numeric_differences(stored: DataFrame, fresh: DataFrame, key: str, vector: str, *, atol: float = 2e-5, rtol: float = 2e-5) -> DataFrame:
    """(key, max_abs, ok) for the keys of ``fresh``: every element within atol + rtol * |stored|; a missing or shorter vector isn't ok."""
    a = stored.select(F.col(key), F.col(vector).alias("_a"))
    b = fresh.select(F.col(key), F.col(vector).alias("_b"))
    off = F.zip_with("_a", "_b", lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    close = F.forall(F.zip_with("_a", "_b", lambda x, y: F.coalesce(F.abs(x.cast("double") - y.cast("double")) <= atol + rtol * F.abs(x.cast("double")), F.lit(False))), lambda ok: ok)
    joined = b.join(a, key, "left")
    return joined.select(key, F.array_max(off).alias("max_abs"), F.coalesce(close & (F.size("_a") == F.size("_b")), F.lit(False)).alias("ok"))


def numeric_guard(stored: DataFrame, fresh: DataFrame, key: str, vector: str, **tolerance: float) -> DataFrame:
    M.expect_none(numeric_differences(stored, fresh, key, vector, **tolerance).where("not ok"), f"{vector} differs from the stored one")
    return fresh


def within_tolerance(found: DataFrame, expected: DataFrame, key: str, value: str) -> DataFrame:
    """(key, expected, found, verdict) for every row of ``expected`` (key, value, tolerance): ok, off, or missing; missing never passes."""
    got = found.select(F.col(key), F.col(value).cast("double").alias("found"))
    want = expected.select(F.col(key), F.col(value).cast("double").alias("expected"), "tolerance")
    verdict = F.when(F.col("found").isNull() | F.isnan("found"), "missing").when(F.abs(F.col("found") - F.col("expected")) <= F.col("tolerance"), "ok").otherwise("off")
    return want.join(got, key, "left").select(key, "expected", "found", verdict.alias("verdict"))


@dataclass(frozen=True)
class TableRules:
    """What ``guarded`` asks of a pair table."""

    key: str
    status: str
    labels: tuple[str, ...]
    vector: str
    bins: int
    dependency: tuple[str, str] | None = None
    population: dict[str, int] = field(default_factory=dict)


def guarded(spark: SparkSession, path: str, rules: TableRules) -> DataFrame:
    """The columns that the rules name, read, trimmed and checked in one call.

    Unique keys, all rows ok, no empty label, vectors of the right length and
    finite, the dependency (key, value), and the population's counts.
    """
    df = M.require_columns(spark.read.parquet(path), rules.key, rules.status, *rules.labels, rules.vector)
    text = [c for c in rules.labels if dict(df.dtypes)[c] == "string"]
    df = df.select(rules.key, rules.status, *[F.trim(c).alias(c) if c in text else F.col(c) for c in rules.labels], rules.vector)
    if text:
        M.nonempty_guard(df, *text)
    M.unique_guard(df, rules.key)
    M.expect_none(df.where(~F.coalesce(F.lower(F.trim(rules.status)) == "ok", F.lit(False))).select(rules.key, rules.status), "rows that aren't ok")
    right = is_finite(F.col(rules.vector)) & (F.size(rules.vector) == rules.bins)
    M.expect_none(df.where(~F.coalesce(right, F.lit(False))).select(rules.key), f"{rules.vector} isn't {rules.bins} finite numbers")
    if rules.dependency:
        M.dependency_guard(df, *rules.dependency)
    if rules.population:
        M.population_guard(df, **rules.population)
    return df


def speaker_of(pairs: DataFrame, manifest: DataFrame, key: str, speaker: str = "speaker_id") -> DataFrame:
    """``pairs`` with the manifest's speaker, 'unknown' where it has none or no such column."""
    kept = pairs.drop(speaker)
    if speaker not in manifest.columns:
        return kept.withColumn(speaker, F.lit("unknown"))
    own = manifest.groupBy(key).agg(F.min(F.nullif(F.trim(F.col(speaker).cast("string")), F.lit(""))).alias(speaker))
    return kept.join(own, key, "left").na.fill("unknown", [speaker])


def rejoined(df: DataFrame, dimension: DataFrame, key: str, *columns: str, front: Sequence[str] = ()) -> DataFrame:
    """``df`` with the dimension's ``columns`` in place of any it had, those of ``front`` first; the dimension must be unique by key."""
    M.unique_guard(dimension, key)
    joined = df.drop(*columns).join(dimension.select(key, *columns), key, "left")
    return joined.select(*front, *[c for c in joined.columns if c not in front])


def inconsistent(a: DataFrame, b: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, columns) of the keys that both tables hold and describe differently; nulls equal each other."""
    right = b.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    differs = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in columns]))
    return a.select(key, *columns).join(right, key).select(key, F.array_join(differs, "|").alias("columns")).where("columns <> ''")


def self_vocoding_reason(fake: Column, real: Column, most: float = 0.25) -> Column:
    """The reason where a resynthesis differs from its original by more than ``most`` seconds, else null."""
    gap = F.abs(fake - real)
    return F.when(gap > most, F.format_string("self_vocoding_duration_mismatch:%.3fs", gap))


def relaxed(status: Column, reason: Column, fake_path: Column, real_path: Column, fake_hash: Column, real_hash: Column, only: str = "duration_ratio_out_of_bounds") -> Column:
    """ok, or nothing but the duration failed and both paths and both hashes are there."""
    has = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    alone = F.array_distinct(F.filter(F.transform(F.split(F.coalesce(reason, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")) == F.array(F.lit(only))
    return (F.lower(F.trim(status)) == "ok") | (alone & has(fake_path) & has(real_path) & has(fake_hash) & has(real_hash))


def _bytes(files: DataFrame) -> int:
    """About what the rows take in memory: their strings, and 64 bytes a row for the rest."""
    strings = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in files.dtypes if kind == "string"]
    return files.agg(F.sum(sum(strings, F.lit(64)))).first()[0] or 0


def manifest_rows(candidates: DataFrame, measured: DataFrame, *, real_measured: DataFrame | None = None, min_ratio: float = 0.5, max_ratio: float = 2.0, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row for every candidate (pair_id, fake_path, real_path, ...), those that fail included.

    ``measured``: (path, sha256, duration, qc_status, exclusion_reason), one row
    for each distinct file; a file that wasn't measured is missing.
    ``real_measured``: the real files where they are known apart, else
    ``measured`` has both. The pair's reasons are its sides', prefixed, and the
    ratio of durations.

    Candidates are shuffled only for a side whose files are too many to be
    broadcast, and for one side before they carry hashes. What was shuffled
    lies by the path of the side joined last, so that its hashes repeat row
    by row and take little where the manifest is written.
    """
    files = {"fake": measured, "real": measured if real_measured is None else real_measured}
    weight = {"fake": _bytes(measured)}
    weight["real"] = weight["fake"] if real_measured is None else _bytes(real_measured)
    out = candidates
    few = [side for side in files if weight[side] <= broadcast_bytes]
    order = [side for side in files if side not in few] + few
    hashable = broadcast_bytes * int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for side in order:
        own = files[side].select(F.col("path").alias(f"{side}_path"), F.col("sha256").alias(f"{side}_sha256"), F.col("duration").alias(f"{side}_duration"), F.coalesce("qc_status", F.lit("fail")).alias(f"_{side}_status"), F.coalesce("exclusion_reason", F.lit("")).alias(f"_{side}_why"))
        shuffled = own.hint("merge" if side == order[-1] or weight[side] > hashable else "shuffle_hash")
        out = out.join(F.broadcast(own) if side in few else shuffled, f"{side}_path", "left")
    of = lambda side: F.transform(F.filter(F.split(F.when(F.col(f"_{side}_status").isNull(), "missing").otherwise(F.col(f"_{side}_why")), ";"), lambda x: x != ""), lambda x: F.concat(F.lit(f"{side}:"), x))
    both = F.col("fake_duration").isNotNull() & F.col("real_duration").isNotNull()
    ratio = F.when(both & ~M.ratio_ok(F.col("fake_duration"), F.col("real_duration"), min_ratio, max_ratio), F.array(F.lit("duration_ratio_out_of_bounds"))).otherwise(F.expr("cast(array() as array<string>)"))
    out = out.withColumn("exclusion_reason", F.array_join(F.concat(of("fake"), of("real"), ratio), ";"))
    ok = (F.col("exclusion_reason") == "") & (F.col("_fake_status") == "ok") & (F.col("_real_status") == "ok")
    out = out.withColumn("qc_status", F.when(ok, "ok").otherwise("fail"))
    out = out.withColumn("exclusion_reason", F.when((F.col("qc_status") == "fail") & (F.col("exclusion_reason") == ""), append_reason(F.col("exclusion_reason"), "side_failed")).otherwise(F.col("exclusion_reason")))
    paths = ["real_path", "fake_path"]
    out = out.select(*paths, *[c for c in candidates.columns if c not in paths], "fake_sha256", "fake_duration", "real_sha256", "real_duration", "exclusion_reason", "qc_status")
    return out.sortWithinPartitions(f"{order[-1]}_path") if len(few) == 1 else out


def preview(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows by a total order."""
    return df.orderBy(*order).limit(n)


def dense_index(df: DataFrame, name: str, *order: str) -> DataFrame:
    """``df`` with a gapless number from 0 over the whole table, by a total order."""
    return M.ranked(df, [], list(order)).withColumn(name, F.col("_rank").cast("long")).drop("_rank", "_n")


def chunk_ranges(n: int, size: int) -> list[tuple[int, int]]:
    """(start, end) of chunks of at most ``size`` that cover 0..n."""
    if size < 1:
        raise ValueError("a chunk has at least one row")
    return [(start, min(start + size, n)) for start in range(0, n, size)]
