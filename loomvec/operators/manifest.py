"""Manifest rules: guards, reasons, balance, hash audits, eligibility, pairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomvec.functions.hashing import seed_hex16
from loomvec.functions.text import append_reason, joined_set
from loomvec.functions.vectors import is_finite
from loomvec.session import materialize


class GuardError(ValueError):
    """A table breaks a rule that the analysis depends on."""


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise GuardError(f"missing columns: {', '.join(missing)}")
    return df


def first_column(df: DataFrame, *candidates: str) -> str:
    """The first of the names that the table has."""
    for name in candidates:
        if name in df.columns:
            return name
    raise GuardError(f"none of the columns {', '.join(candidates)}")


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def ambiguous(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value: they break key -> value."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


def expect_none(df: DataFrame, what: str, examples: int = 10) -> None:
    found = df.limit(examples).collect()
    if found:
        raise GuardError(f"{what}: {[tuple(r) for r in found]}")


def unique_guard(df: DataFrame, *keys: str) -> DataFrame:
    expect_none(repeated_keys(df, *keys), f"repeated {'+'.join(keys)}")
    return df


def dependency_guard(df: DataFrame, key: str, value: str) -> DataFrame:
    expect_none(ambiguous(df, key, value), f"{key} doesn't determine {value}")
    return df


def finite_guard(df: DataFrame, vector: str) -> DataFrame:
    expect_none(df.where(~is_finite(F.col(vector))).select(F.lit(1)), f"{vector} isn't finite")
    return df


def nonempty_guard(df: DataFrame, *names: str) -> DataFrame:
    blank = F.lit(False)
    for name in names:
        blank = blank | (F.trim(F.coalesce(name, F.lit(""))) == "")
    expect_none(df.where(blank).select(*names), "empty text")
    return df


def population_guard(df: DataFrame, **expected: int) -> DataFrame:
    """``rows=n`` and distinct counts of columns must be as expected."""
    names = [n for n in expected if n != "rows"]
    got = df.agg(F.count("*").alias("rows"), *[F.count_distinct(n).alias(n) for n in names]).first()
    wrong = {n: (got[n], v) for n, v in expected.items() if got[n] != v}
    if wrong:
        raise GuardError(f"population: {wrong}")
    return df


def subset_guard(small: DataFrame, large: DataFrame, *keys: str) -> None:
    expect_none(small.join(large, list(keys), "left_anti").select(*keys), "not a subset")


def ratio_ok(fake: Column, real: Column, low: float = 0.5, high: float = 2.0) -> Column:
    """False for a null side or a real duration that isn't positive."""
    return F.coalesce((real > 0) & F.try_divide(fake, real).between(low, high), F.lit(False))


def reasons(*rules: tuple[Column, str]) -> Column:
    """';' list of the texts whose condition holds."""
    return F.concat_ws(";", *[F.when(cond, F.lit(text)) for cond, text in rules])


def balanced(df: DataFrame, original: str, generator: str) -> DataFrame:
    """Rows of the originals that every generator has."""
    per = df.groupBy(original).agg(F.count_distinct(generator).alias("n"))
    every = df.agg(F.count_distinct(generator).alias("all"))
    full = per.join(F.broadcast(every), F.col("n") == F.col("all")).select(original)
    return df.join(full, original, "left_semi")


def coverage(df: DataFrame, original: str, generator: str) -> DataFrame:
    """How many originals have how many generators."""
    per = df.groupBy(original).agg(F.count_distinct(generator).alias("n_generators"))
    return per.groupBy("n_generators").agg(F.count("*").alias("n_originals"))


def hash_groups(df: DataFrame, sha: str, original: str, generator: str) -> DataFrame:
    """Rows, originals and generators of every hash that isn't null."""
    return df.where(F.col(sha).isNotNull()).groupBy(F.col(sha).alias("sha256")).agg(F.count("*").alias("n_rows"), F.count_distinct(original).alias("n_original_ids"), F.count_distinct(generator).alias("n_generators"))


def _fail(df: DataFrame, sha: str, hashes: DataFrame, reason: str) -> DataFrame:
    marked = df.join(hashes.select(F.col("sha256").alias(sha), F.lit(True).alias("_hit")), sha, "left")
    hit = F.coalesce("_hit", F.lit(False)) & (F.col("qc_status") == "ok")
    return marked.withColumn("exclusion_reason", F.when(hit, append_reason(F.col("exclusion_reason"), reason)).otherwise(F.col("exclusion_reason"))).withColumn("qc_status", F.when(hit, F.lit("fail")).otherwise(F.col("qc_status"))).drop("_hit")


def hash_audit(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sequential audit: each step looks at the rows that the one before left ok.

    A fake hash of several originals or generators fails all its rows; a real
    hash of several originals does; a fake hash that is a real one fails the
    fake rows. Returns the table and the audit rows.
    """
    columns = df.columns
    df = materialize(df, "hashed")  # the hashes are made once, not in every step
    ok = lambda t: t.where("qc_status = 'ok'")
    fake = hash_groups(ok(df), "fake_sha256", "original_id", "generator").where("n_original_ids > 1 or n_generators > 1")
    one = _fail(df, "fake_sha256", fake, "ambiguous_fake_hash_duplicate")
    real = hash_groups(ok(one), "real_sha256", "original_id", "generator").where("n_original_ids > 1")
    two = _fail(one, "real_sha256", real, "ambiguous_real_hash_duplicate")
    both = ok(two).select(F.col("fake_sha256").alias("sha256")).intersect(ok(two).select("real_sha256")).where("sha256 is not null")
    three = _fail(two, "fake_sha256", both, "fake_real_hash_collision")
    kinds = [("ambiguous_fake_hash", fake), ("ambiguous_real_hash", real)]
    audit = None
    for kind, rows in kinds:
        rows = rows.select(F.lit(kind).alias("audit_type"), "sha256", "n_rows")
        audit = rows if audit is None else audit.unionByName(rows)
    held = two.join(both.withColumnRenamed("sha256", "fake_sha256"), "fake_sha256", "left_semi").groupBy(F.col("fake_sha256").alias("sha256")).agg(F.count("*").alias("n_rows"))
    audit = audit.unionByName(held.select(F.lit("fake_real_hash_collision").alias("audit_type"), "sha256", "n_rows"))
    return three.select(*columns), audit


def eligibility(df: DataFrame, min_pairs: int = 30, min_generators: int = 3) -> tuple[DataFrame, DataFrame]:
    """Generators (enough pairs, confidence high or medium) and families (enough such generators)."""
    per = df.groupBy("family", "generator", "confidence").agg(F.count("*").alias("n_pairs"), F.count_distinct("language").alias("n_languages"), joined_set(F.col("language")).alias("languages"))
    per = per.withColumn("eligible", (F.col("n_pairs") >= min_pairs) & F.lower("confidence").isin("high", "medium"))
    families = per.where("eligible").groupBy("family").agg(F.count_distinct("generator").alias("n_generators"), F.sum("n_pairs").alias("n_pairs"))
    return per, families.withColumn("eligible", F.col("n_generators") >= min_generators)


def ranked(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``_rank`` from 0 in its group by a total ``order``, and ``_n``, the group's rows.

    Rows are dealt out by ranges of group and order and numbered there; a
    range's first number comes from the counts of the ranges before it. So a
    group of any size is spread over tasks, and no task holds more than a range.
    """
    placed = materialize(df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    key = F.struct(*[F.col(g) for g in group], F.lit(0).alias("_"))
    counts = placed.groupBy(key.alias("_key"), "_part").agg(F.count("*").alias("_rows"))
    line = Window.partitionBy("_key").orderBy("_part")
    before = F.coalesce(F.sum("_rows").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_key", F.col("_part").alias("_p"), before.alias("_from"), F.sum("_rows").over(Window.partitionBy("_key")).alias("_n"))
    inner = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order)) - 1
    numbered = placed.withColumn("_inner", inner).join(counts, key.eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p")))
    return numbered.withColumn("_rank", F.col("_inner") + F.col("_from")).drop("_inner", "_from", "_key", "_part", "_p")


def _partners(placed: DataFrame, item: str, group: list[str], shift: Column) -> DataFrame:
    """(group, item, partner): the item ``shift`` places on in its group, around its end."""
    key = lambda x: F.struct(*[F.col(g) for g in group], x)
    to = placed.select(key(F.col("_rank")).alias("_to"), F.col(item).alias("partner"))
    wanted = placed.withColumn("_at", key(((F.col("_rank") + shift) % F.col("_n")).alias("_rank")))
    return wanted.join(to, F.col("_at").eqNullSafe(F.col("_to"))).select(*group, item, "partner")


def rotated(df: DataFrame, item: str, *group: str) -> DataFrame:
    """(group, item, partner): the next item of the group in order, the last wraps around."""
    return _partners(ranked(df.select(*group, item).distinct(), list(group), [item]), item, list(group), F.lit(1))


def mismatch(df: DataFrame, original: str, speaker: str) -> DataFrame:
    """(original, speaker, partner) within the speaker; where that is the original itself, the next one overall."""
    own = rotated(df, original, speaker)
    overall = rotated(df.select(original), original).withColumnRenamed("partner", "_wrap")
    return own.join(overall, original).select(original, speaker, F.when(F.col("partner") == F.col(original), F.col("_wrap")).otherwise(F.col("partner")).alias("partner"))


def hashed_rotation(df: DataFrame, item: str, label: str, *group: str) -> DataFrame:
    """(group, item, partner) by a shift of 1 + hash mod (n - 1) within the group; groups of one give none."""
    placed = ranked(df.select(*group, item).distinct(), list(group), [item]).where("_n > 1")
    return _partners(placed, item, list(group), 1 + seed_hex16(F.lit(label), *[F.col(g) for g in group]) % (F.col("_n") - 1))


def same_language_partner(df: DataFrame, original: str, language: str, speaker: str) -> DataFrame:
    """(original, partner, rule): a hashed shift within language and speaker, else within the language; an original alone in its language fails.

    One speaker's originals never meet themselves; an unknown speaker counts as a speaker.
    """
    named = df.select(original, language, F.coalesce(F.col(speaker).cast("string"), F.lit("unknown")).alias(speaker)).distinct()
    close = hashed_rotation(named, original, "mismatch", language, speaker).select(original, "partner")
    far = hashed_rotation(named, original, "mismatch_lang", language).select(original, F.col("partner").alias("_far"))
    both = named.select(original).distinct().join(close, original, "left").join(far, original, "left")
    found = F.coalesce("partner", "_far", F.raise_error(F.concat(F.lit("no partner of its language for "), F.col(original).cast("string"))).cast(dict(df.dtypes)[original]))
    return both.select(original, found.alias("_found"), F.when(F.col("partner").isNotNull(), "same_language_same_speaker").otherwise("same_language").alias("rule")).withColumnRenamed("_found", "partner")


def resolve_paths(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(path, resolved, method): the file itself, else the only one with one folder put in after the first.

    ``wanted`` and ``files`` have a column ``path`` of cleaned relative paths.
    """
    known = files.select("path").distinct()
    direct = known.select("path", F.lit(True).alias("_direct"))
    parts = F.split("path", "/", -1)
    inner = known.where(F.size(parts) > 2).select(F.concat_ws("/", F.get(parts, F.lit(0)), F.array_join(F.slice(parts, 3, F.size(parts)), "/")).alias("short"), F.col("path").alias("long"))
    inner = inner.groupBy(F.col("short").alias("path")).agg(F.count("*").alias("_n"), F.min("long").alias("_long"))
    joined = wanted.select("path").distinct().join(direct, "path", "left").join(inner, "path", "left")
    method = F.when(F.col("_direct"), "direct").when(F.col("_n") == 1, "inserted_second_level_unique").when(F.col("_n") > 1, "ambiguous_multiple_matches").otherwise("not_found")
    return joined.select("path", F.when(F.col("_direct").isNull() & (F.col("_n") == 1), F.col("_long")).otherwise(F.col("path")).alias("resolved"), method.alias("method"))


def last_wins(df: DataFrame, order: list[str], *keys: str) -> DataFrame:
    """The last row of each key; ``order`` must be total."""
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_row"))
    return newest.select("_row.*")


def blocks_by_rank(df: DataFrame, item: str, token: Column, n: int, *group: str) -> DataFrame:
    """Content block of each item: rank of its token's hash within the group, modulo n."""
    items = df.select(*group, item).distinct().withColumn("_token", token)
    return ranked(items, list(group), ["_token", item]).select(*group, item, (F.col("_rank") % n).cast("int").alias("block"))


def blocks_by_hash(df: DataFrame, item: str, label: str, n: int) -> DataFrame:
    """Content block of each item: hash modulo n, no ordering needed."""
    return df.select(item).distinct().withColumn("block", (seed_hex16(F.lit(label), F.col(item)) % n).cast("int"))
