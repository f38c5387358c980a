"""From vectors to per-bin medians, language references and profiles.

The long view (keys, bin, v) carries all aggregates: a median by keys and bin
is one shuffle on those keys. Tables by generator are small whatever the
number of recordings, and become arrays again for comparisons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomvec.functions import vectors as V


def long_view(df: DataFrame, vector: str, *keys: str) -> DataFrame:
    """One row for each bin: keys, bin, v (double). NaN is refused by ``finite_guard``."""
    return df.select(*keys, F.posexplode(vector).alias("bin", "v")).withColumn("v", F.col("v").cast("double"))


def bin_medians(long: DataFrame, *keys: str) -> DataFrame:
    """Median of v and number of rows by keys and bin."""
    return long.groupBy(*keys, "bin").agg(F.median("v").alias("v"), F.count("*").alias("n_pairs"))


#: Values beyond which medians are taken in passes, and the parts of a key's range that are counted.
LARGE, PARTS = 1 << 26, 1024


def large_medians(long: DataFrame, *keys: str) -> DataFrame:
    """What ``bin_medians`` gives, exactly, without shuffling every value.

    Three passes: each key's range, counts over ``PARTS`` equal parts of it,
    both combined on the map side, and the values of the one or two parts that
    hold the middle ranks. ``long`` is read three times and should be a table.
    """
    key = [*keys, "bin"]
    span = long.groupBy(*key).agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"), F.count("*").alias("n_pairs"))
    wide = F.col("_hi") - F.col("_lo")
    part = F.when(wide > 0, F.least(F.lit(PARTS - 1), F.floor((F.col("v") - F.col("_lo")) / wide * PARTS))).otherwise(F.lit(0)).cast("int")
    placed = long.join(span, key).withColumn("_part", part)
    counted = placed.groupBy(*key, "n_pairs", "_part").agg(F.count("*").alias("_c"))
    line = Window.partitionBy(*key).orderBy("_part")
    before = F.sum("_c").over(line) - F.col("_c")
    low, high = F.floor((F.col("n_pairs") - 1) / 2), F.floor(F.col("n_pairs") / 2)
    inside = lambda r: (F.col("_before") <= r) & (r < F.col("_before") + F.col("_c"))
    wanted = counted.withColumn("_before", before).where(inside(low) | inside(high)).select(*key, "_part", "_before")
    middle = placed.join(wanted, [*key, "_part"]).groupBy(*key, "n_pairs").agg(F.sort_array(F.collect_list("v")).alias("_s"), F.min("_before").alias("_b"))
    at = lambda r: F.get("_s", (r - F.col("_b")).cast("int"))
    return middle.select(*key, ((at(low) + at(high)) / 2).alias("v"), "n_pairs")


def profiles(cells: DataFrame, *keys: str) -> DataFrame:
    """Median over the cells of each key (every language weighs the same), as an array ``r`` by bin."""
    medians = cells.groupBy(*keys, "bin").agg(F.median("v").alias("v"))
    packed = medians.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", "v"))).alias("bins"))
    return packed.select(*keys, F.col("bins.v").alias("r"))


def band(axis_hz: Column, low: float = 80.0, high: float = 7600.0) -> Column:
    return axis_hz.between(low, high)


def centred(df: DataFrame, vector: str, first: int, size: int) -> DataFrame:
    """``offset_db`` (median over the band) and the vector less it, all bins."""
    numbers = F.transform(F.col(vector), lambda x: x.cast("double"))
    with_offset = df.withColumn("_d", numbers).withColumn("offset_db", V.median(F.slice("_d", first + 1, size)))
    return with_offset.withColumn(vector, F.transform("_d", lambda x: x - F.col("offset_db"))).drop("_d")


def band_stats(long: DataFrame, hz: Column, *keys: str) -> DataFrame:
    """Means of the low, mid and high band (right-open) and the root mean square over all bins."""
    mean = lambda lo, hi: F.avg(F.when((hz >= lo) & (hz < hi), F.col("v")))
    return long.groupBy(*keys).agg(mean(0, 1000).alias("lf_mean"), mean(1000, 4000).alias("mf_mean"), mean(4000, 8001).alias("hf_mean"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("residual_l2"))


def language_reference(cells: DataFrame, least: int = 2, short: str = "drop") -> DataFrame:
    """Cross-fitted reference of every cell: the median over other generators of its language.

    Rows are (generator, language, bin, ref, n_reference). Cells with fewer
    than ``least`` other generators are left out (``short`` "drop"), make the
    table fail when it is read ("raise"), or take the median over all other
    generators' cells of any language ("global").
    """
    other = cells.select(F.col("generator").alias("og"), "language", "bin", F.col("v").alias("ov"))
    joined = cells.join(other, ["language", "bin"]).where("og <> generator")
    found = joined.groupBy("generator", "language", "bin").agg(F.median("ov").alias("ref"), F.count_distinct("og").alias("n_reference"))
    if short == "drop":
        return found.where(F.col("n_reference") >= least)
    every = cells.select("generator", "language", "bin").distinct().join(found, ["generator", "language", "bin"], "left").na.fill(0, ["n_reference"])
    enough = F.col("n_reference") >= least
    if short == "raise":
        why = F.concat(F.lit("too few other generators for "), F.col("generator").cast("string"), F.lit(" in "), F.col("language").cast("string"))
        return every.withColumn("ref", F.when(enough, F.col("ref")).otherwise(F.raise_error(why).cast("double")))
    if short != "global":
        raise ValueError(f"short is drop, raise or global, not {short}")
    whole = cells.select(F.col("generator"), "bin").distinct().join(other.select("og", "bin", "ov"), "bin").where("og <> generator").groupBy("generator", "bin").agg(F.median("ov").alias("_all"))
    return every.join(whole, ["generator", "bin"], "left").withColumn("ref", F.when(enough, F.col("ref")).otherwise(F.col("_all"))).drop("_all").select("generator", "language", "bin", "ref", "n_reference")


def adjusted(cells: DataFrame, least: int = 2) -> DataFrame:
    """Cells less their language reference."""
    joined = cells.join(language_reference(cells, least), ["generator", "language", "bin"])
    return joined.withColumn("v", F.col("v") - F.col("ref")).drop("ref")


def robust_scale(long: DataFrame, *by: str) -> DataFrame:
    """(by, bin, centre, scale): median and 1.4826 MAD, else the standard deviation, else 1."""
    centre = long.groupBy(*by, "bin").agg(F.median("v").alias("centre"), F.stddev_samp("v").alias("sd"))
    away = long.join(centre, [*by, "bin"]).groupBy(*by, "bin", "centre", "sd").agg((F.median(F.abs(F.col("v") - F.col("centre"))) * 1.4826).alias("mad"))
    scale = F.when(F.col("mad") > 1e-8, F.col("mad")).when(F.col("sd") > 1e-8, F.col("sd")).otherwise(F.lit(1.0))
    return away.select(*by, "bin", "centre", scale.alias("scale"))


def scaled(long: DataFrame, fitted: DataFrame, *by: str) -> DataFrame:
    return long.join(fitted, [*by, "bin"]).withColumn("v", (F.col("v") - F.col("centre")) / F.col("scale")).drop("centre", "scale")


def arrays(long: DataFrame, *keys: str) -> DataFrame:
    """(keys, r): the bins of each key in order."""
    return long.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", "v"))).alias("bins")).select(*keys, F.col("bins.v").alias("r"))


def pairs(df: DataFrame, key: str) -> DataFrame:
    """All pairs of rows of a small table with key_a < key_b; columns get the suffixes _a and _b."""
    a = df.select(*[F.col(c).alias(f"{c}_a") for c in df.columns])
    b = df.select(*[F.col(c).alias(f"{c}_b") for c in df.columns])
    return a.join(b, F.col(f"{key}_a") < F.col(f"{key}_b"))
