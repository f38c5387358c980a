"""Statistics, resampling on plan tables, and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upper_p(null: Column, observed: Column, tol: float = 1e-15) -> Column:
    """Aggregate: (1 + draws at or above) / (draws + 1)."""
    return (F.count_if(null >= observed - tol) + 1) / (F.count("*") + 1)


def holm(df: DataFrame, p: str, out: str, *by: str) -> DataFrame:
    """Holm's adjustment within ``by``; null and NaN p-values stay null and don't count."""
    good = F.col(p).isNotNull() & ~F.isnan(p)
    group = Window.partitionBy(*by, good)
    line = group.orderBy(p, *[c for c in df.columns if c != p])
    raw = (F.count("*").over(group) - F.row_number().over(line) + 1) * F.col(p)
    df = df.withColumn("_raw", raw)
    return df.withColumn(out, F.when(good, F.least(F.lit(1.0), F.max("_raw").over(line.rowsBetween(Window.unboundedPreceding, 0))))).drop("_raw")


def benjamini_hochberg(df: DataFrame, p: str, out: str, *by: str) -> DataFrame:
    """False discovery rate within ``by``; null and NaN p-values stay null and don't count."""
    good = F.col(p).isNotNull() & ~F.isnan(p)
    group = Window.partitionBy(*by, good)
    rest = [c for c in df.columns if c != p]
    df = df.withColumn("_raw", F.col(p) * F.count("*").over(group) / F.row_number().over(group.orderBy(p, *rest)))
    down = group.orderBy(F.col(p).desc(), *[F.col(c).desc() for c in rest]).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.when(good, F.least(F.lit(1.0), F.min("_raw").over(down)))).drop("_raw")


def valid_p(df: DataFrame, p: str) -> DataFrame:
    """``df``; it fails when read if a p-value is null, NaN or outside 0..1."""
    ok = F.col(p).isNotNull() & ~F.isnan(p) & F.col(p).between(0.0, 1.0)
    return df.withColumn(p, F.when(ok, F.col(p)).otherwise(F.raise_error(F.concat(F.lit("not a p-value: "), F.coalesce(F.col(p).cast("string"), F.lit("null")))).cast("double")))


def signflip_p(values: DataFrame, value: str, most: int = 20) -> DataFrame:
    """Exact one-sided sign-flip test of a mean over at most ``most`` values: one row (n, mean, p)."""
    packed = values.where(F.col(value).isNotNull() & ~F.isnan(value)).agg(F.collect_list(F.col(value).cast("double")).alias("v"))
    n = F.size("v")
    packed = packed.withColumn("n", F.when(n > most, F.raise_error(F.lit("too many values for all sign flips"))).otherwise(n))
    flips = packed.select("n", "v", F.explode(F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.col("n")) - 1)).alias("mask"))
    signed = F.aggregate(F.transform("v", lambda x, i: F.when(F.call_function("shiftright", F.col("mask"), i).bitwiseAND(1) == 1, -x).otherwise(x)), F.lit(0.0), lambda s, x: s + x) / F.col("n")
    draws = flips.select("n", (F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.col("n")).alias("mean"), signed.alias("draw"))
    return draws.groupBy("n", "mean").agg(F.avg((F.col("draw") >= F.col("mean") - 1e-15).cast("double")).alias("p"))


def wilcoxon(values: DataFrame, value: str, *by: str) -> DataFrame:
    """Signed-rank sum: n, w_plus, z of the normal approximation (zeros dropped, ties averaged) and whether there are ties."""
    d = values.where(F.col(value) != 0).select(*by, F.col(value).alias("d"), F.abs(value).alias("a"))
    # Ranks by distinct size, so that a common difference is one row of the window.
    sizes = d.groupBy(*by, "a").agg(F.count("*").alias("t"), F.count_if(F.col("d") > 0).alias("plus"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy(*by).orderBy("a").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = sizes.withColumn("rank", before + (F.col("t") + 1) / 2)
    out = ranked.groupBy(*by).agg(F.sum("t").alias("n"), F.sum(F.col("plus") * F.col("rank")).alias("w_plus"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"), F.max(F.col("t") > 1).alias("tied"))
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48.0)
    return out.select(*by, "n", "w_plus", ((F.col("w_plus") - n * (n + 1) / 4) / spread).alias("z"), "tied")


def signflip_sampled(values: DataFrame, value: str, draws: DataFrame) -> DataFrame:
    """(n, mean, p) by drawn sign vectors: ``draws`` (rep, signs) in the order of the values' rows in ``values`` (pos, value)."""
    finite = values.where(F.col(value).isNotNull() & ~F.isnan(value))
    packed = finite.agg(F.array_sort(F.collect_list(F.struct("pos", F.col(value).cast("double").alias("v")))).alias("s")).select(F.col("s.v").alias("v"), F.size("s").alias("n"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    both = draws.join(F.broadcast(packed)).select("n", (total(F.col("v")) / F.col("n")).alias("mean"), (total(F.zip_with("signs", "v", lambda s, x: s * x)) / F.col("n")).alias("draw"))
    return both.groupBy("n", "mean").agg(upper_p(F.col("draw"), F.col("mean")).alias("p"))


def wilcoxon_p(stats: DataFrame, n: str = "n", w: str = "w_plus", z: str = "z", tied: str = "tied", most: int = 50) -> DataFrame:
    """``p`` (one-sided, greater) and ``method``: exact up to ``most`` differences without ties, else by the normal tail.

    Exact: the number of subsets of the ranks 1..n by their sum is built rank
    by rank inside the row.
    """
    small = (F.col(n) <= most) & ~F.col(tied)
    size = F.when(small, F.col(n)).otherwise(F.lit(0)).cast("int")
    top = (size * (size + 1) / 2).cast("int")
    none = F.transform(F.sequence(F.lit(0), top), lambda i: F.when(i == 0, F.lit(1)).otherwise(F.lit(0)).cast("long"))
    grown = lambda counts, k: F.transform(counts, lambda x, i: x + F.when(i >= k, F.get(counts, i - k)).otherwise(F.lit(0).cast("long")))
    ways = F.aggregate(F.filter(F.sequence(F.lit(0), size), lambda k: k > 0), none, grown)
    above = F.aggregate(F.slice(ways, F.greatest(F.col(w).cast("int"), F.lit(0)) + 1, top + 1), F.lit(0).cast("long"), lambda s, x: s + x)
    exact = above.cast("double") / F.pow(F.lit(2.0), size)
    return stats.withColumn("p", F.when(small, exact).otherwise(normal_upper(F.col(z)))).withColumn("method", F.when(small, "exact").otherwise("normal"))


def normal_upper(z: Column) -> Column:
    """Upper tail of the standard normal by a continued fraction (far) or its series (near); JVM-side."""
    x = F.abs(z)
    density = F.exp(-x * x / 2) / 2.5066282746310002
    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(x.alias("t"), x.alias("s")), lambda s, k: F.struct((s["t"] * x * x / (k * 2 + 1)).alias("t"), (s["s"] + s["t"] * x * x / (k * 2 + 1)).alias("s")))["s"]
    fraction = F.aggregate(F.sequence(F.lit(40), F.lit(1), F.lit(-1)), F.lit(0.0), lambda f, k: k / (x + f))
    upper = F.when(x < 3, 0.5 - density * series).otherwise(density / (x + fraction))
    return F.when(z >= 0, upper).otherwise(1 - upper)


def interval(values: Column, level: float = 0.95) -> Column:
    """Aggregate: [low, high] by linear quantiles."""
    tail = (1 - level) / 2
    return F.percentile(values, F.array(F.lit(tail), F.lit(1 - tail)))


def confusion(df: DataFrame, true: str, predicted: str, order: list) -> DataFrame:
    """One row and one column for each class in the given order, zero cells kept."""
    rows = df.sparkSession.createDataFrame([(x,) for x in order], df.select(true).schema)
    counts = df.groupBy(true).agg(*[F.count_if(F.col(predicted) == x).alias(f"pred_{x}") for x in order])
    return rows.join(counts, true, "left").na.fill(0)


def class_scores(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """n, accuracy, balanced accuracy and macro F1 over the true classes (empty precision counts 0)."""
    per_true = df.groupBy(F.col(true).alias("c")).agg(F.count("*").alias("n"), F.count_if(F.col(true) == F.col(predicted)).alias("hit"))
    per_pred = df.groupBy(F.col(predicted).alias("c")).agg(F.count("*").alias("m"))
    both = per_true.join(per_pred, "c", "left").na.fill(0, ["m"])
    return both.agg(F.sum("n").alias("n"), (F.sum("hit") / F.sum("n")).alias("accuracy"), F.avg(F.col("hit") / F.col("n")).alias("balanced_accuracy"), F.avg(2 * F.col("hit") / (F.col("n") + F.col("m"))).alias("macro_f1"))


def class_scores_by(df: DataFrame, true: str, predicted: str, classes: int, *by: str) -> DataFrame:
    """(by, ba, f1): balanced accuracy over the true classes and macro F1 over all ``classes`` (0 for one that never occurs)."""
    hit = F.col(true) == F.col(predicted)
    sides = F.array(F.struct(F.col(true).alias("c"), F.lit(1).alias("n"), F.lit(0).alias("m"), hit.cast("int").alias("hit")), F.struct(F.col(predicted).alias("c"), F.lit(0).alias("n"), F.lit(1).alias("m"), F.lit(0).alias("hit")))
    per = df.select(*by, F.inline(sides)).groupBy(*by, "c").agg(*[F.sum(x).alias(x) for x in ("n", "m", "hit")])
    recall = F.when(F.col("n") > 0, F.col("hit") / F.nullif("n", F.lit(0)))
    return per.groupBy(*by).agg(F.avg(recall).alias("ba"), (F.sum(2 * F.col("hit") / (F.col("n") + F.col("m"))) / classes).alias("f1"))


def h4_verdict(delta: Column, p: dict[str, Column], alpha: float = 0.05) -> Column:
    """SUPPORTED only if the difference is positive, four tests reject and the dispersion test doesn't."""
    ok = (delta > 0) & (p["dispersion"] >= alpha)
    for name in ("family_similarity", "multivariate_centroid", "logo_balanced_accuracy", "logo_macro_f1"):
        ok = ok & (p[name] < alpha)
    return F.when(ok, "SUPPORTED").otherwise("INSUFFICIENT_EVIDENCE")


def h1_verdict(low: Column) -> Column:
    """SUPPORTED if the interval lies above 0."""
    return F.when(low > 0, "SUPPORTED").otherwise("INSUFFICIENT_EVIDENCE")


def co_primary_verdict(shape: dict[str, Column], support: dict[str, Column], alpha: float = 0.05, partial: str = "SHAPE_SUPPORTED_FREQUENCY_INSUFFICIENT") -> Column:
    """Both endpoints (mean, low, p) must have a positive mean, an interval above 0 and p at most ``alpha``; shape alone gives ``partial``."""
    holds = lambda e: F.coalesce((e["mean"] > 0) & (e["low"] > 0) & (e["p"] <= alpha), F.lit(False))
    return F.when(holds(shape) & holds(support), "SUPPORTED").when(holds(shape), partial).otherwise("INSUFFICIENT_EVIDENCE")
