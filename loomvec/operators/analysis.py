"""The analyses: language pairs, family structure, classification, controls, split halves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomvec.functions import vectors as V
from loomvec.functions.hashing import seed_hex16
from loomvec.operators import profiles as P


def language_pairs(cells: DataFrame) -> DataFrame:
    """Per generator and pair of its languages: same-generator likeness less the matched difference.

    ``cells``: (generator, language, r). The baseline is the mean over other
    generators that have both languages, over both orientations.
    """
    left = cells.select("generator", F.col("language").alias("l1"), F.col("r").alias("r1"))
    right = cells.select("generator", F.col("language").alias("l2"), F.col("r").alias("r2"))
    own = left.join(right, "generator").where("l1 < l2")
    shape = lambda a, b: V.pearson(F.col(a), F.col(b))
    support = lambda a, b: V.jaccard(V.top_bins(F.col(a)), V.top_bins(F.col(b)))
    same = own.select("generator", "l1", "l2", shape("r1", "r2").alias("same_shape"), support("r1", "r2").alias("same_support"))
    other = own.select(F.col("generator").alias("h"), "l1", "l2", F.col("r1").alias("h1"), F.col("r2").alias("h2"))
    both = own.join(other, ["l1", "l2"]).where("h <> generator")
    different = both.groupBy("generator", "l1", "l2").agg(F.avg((shape("r1", "h2") + shape("h1", "r2")) / 2).alias("diff_shape"), F.avg((support("r1", "h2") + support("h1", "r2")) / 2).alias("diff_support"))
    return same.join(different, ["generator", "l1", "l2"]).withColumn("delta_shape", F.col("same_shape") - F.col("diff_shape")).withColumn("delta_support", F.col("same_support") - F.col("diff_support"))


def similarity_table(profiles: DataFrame) -> DataFrame:
    """Cosine, Spearman and Euclidean of all pairs of generator profiles."""
    both = P.pairs(profiles.withColumn("k", V.average_ranks(F.col("r"))), "generator")  # ranked once, not for each pair
    a, b = F.col("r_a"), F.col("r_b")
    return both.select("generator_a", "generator_b", "family_a", "family_b", V.cosine(a, b).alias("cosine"), V.pearson(F.col("k_a"), F.col("k_b")).alias("spearman"), V.euclidean(a, b).alias("euclidean"))


def family_delta(table: DataFrame, *by: str) -> DataFrame:
    """Mean within less mean between families over a pair table."""
    same = F.col("family_a") == F.col("family_b")
    out = table.groupBy(*by).agg(F.avg(F.when(same, F.col("cosine"))).alias("within"), F.avg(F.when(~same, F.col("cosine"))).alias("between"))
    return out.withColumn("delta", F.col("within") - F.col("between"))


def jackknife(table: DataFrame) -> DataFrame:
    """Family delta without each generator in turn."""
    every = table.select(F.col("generator_a").alias("left_out")).unionByName(table.select(F.col("generator_b").alias("left_out"))).distinct()
    kept = table.join(every, (F.col("generator_a") != F.col("left_out")) & (F.col("generator_b") != F.col("left_out")))
    return family_delta(kept, "left_out")


def jackknife_interval(folds: DataFrame, observed: DataFrame) -> DataFrame:
    n = F.col("n")
    spread = folds.agg(F.count("*").alias("n"), F.sqrt(F.var_pop("delta")).alias("sd"))
    joined = spread.crossJoin(F.broadcast(observed.select(F.col("delta").alias("observed"))))
    se = F.sqrt((n - 1).cast("double")) * F.col("sd")
    return joined.select("observed", se.alias("se"), (F.col("observed") - 1.959963984540054 * se).alias("low"), (F.col("observed") + 1.959963984540054 * se).alias("high"))


def within_outside(table: DataFrame) -> DataFrame:
    """Per family: mean inside, mean to the others, difference."""
    sides = table.select("cosine", "family_a", "family_b", F.explode(F.array_distinct(F.array("family_a", "family_b"))).alias("family"))
    inside = (F.col("family_a") == F.col("family")) & (F.col("family_b") == F.col("family"))
    out = sides.groupBy("family").agg(F.avg(F.when(inside, F.col("cosine"))).alias("inside"), F.avg(F.when(~inside, F.col("cosine"))).alias("outside"))
    return out.withColumn("delta", F.col("inside") - F.col("outside"))


def family_contrast(table: DataFrame, draws: DataFrame) -> DataFrame:
    """(family, kind, n, within, outside, delta) of each draw of positions ``a`` against ``b``.

    Positions count the generators of the pair ``table`` in order. Pairs of one
    generator with itself are left out inside; a draw without any pair has null.
    """
    a, b, cosine = F.col("a"), F.col("b"), F.coalesce("cosine", F.lit(0.0))  # a zero profile is like none
    sides = [table.select(F.col(f"generator_{x}").alias("g"), F.col(f"generator_{y}").alias("h"), cosine.alias("c")) for x, y in ("ab", "ba")]
    one = sides[0].unionByName(sides[1])
    one = one.unionByName(one.select("g", F.col("g").alias("h"), F.lit(1.0).alias("c")).distinct())
    lines = one.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("h", "c"))).alias("line"))
    matrix = lines.agg(F.array_sort(F.collect_list(F.struct("g", F.col("line.c").alias("c")))).alias("m")).select(F.col("m.c").alias("m"))
    look = lambda x, y: F.get(F.get(F.col("m"), x), y)
    inside = F.flatten(F.transform(a, lambda x, i: F.transform(F.filter(F.slice(a, i + 2, F.size(a)), lambda y: y != x), lambda y: look(x, y))))
    across = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: look(x, y))))
    mean = lambda v: V.let(v, lambda v: F.when(F.size(v) > 0, V.total(v) / F.size(v)))
    out = draws.join(F.broadcast(matrix)).select("family", "kind", F.size("a").alias("n"), mean(inside).alias("within"), mean(across).alias("outside"))
    return out.withColumn("delta", F.col("within") - F.col("outside"))


def subset_likeness(profiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """(test, fam, n, real, rho): likeness of the medians of two groups of generators, of contexts 0 and 1.

    ``profiles``: (ctx, generator, r); ``pairs``: (test, fam, n, real, a, b). A
    group's median is computed once, however many pairs hold it.
    """
    sides = [pairs.select(F.lit(ctx).alias("ctx"), F.col(side).alias("s")) for ctx, side in ((0, "a"), (1, "b"))]
    members = sides[0].unionByName(sides[1]).distinct().select("ctx", "s", F.explode("s").alias("generator"))
    medians = members.join(F.broadcast(profiles.select("ctx", "generator", "r")), ["ctx", "generator"]).groupBy("ctx", "s").agg(F.collect_list("r").alias("all"))
    medians = medians.select("ctx", "s", V.median_of(F.col("all")).alias("r"))
    left, right = (medians.where(f"ctx = {ctx}").select(F.col("s").alias(side), F.col("r").alias(f"r{side}")) for ctx, side in ((0, "a"), (1, "b")))
    return pairs.join(left, "a").join(right, "b").select("test", "fam", "n", "real", V.pearson(F.col("ra"), F.col("rb")).alias("rho"))


def centroid_f(long: DataFrame, *by: str) -> DataFrame:
    """PERMANOVA-like F and R2 of (by, generator, family, bin, v)."""
    k = long.groupBy(*by, "family").agg(F.count_distinct("generator").alias("size"))
    mean_of = long.groupBy(*by, "family", "bin").agg(F.avg("v").alias("fm"))
    grand = long.groupBy(*by, "bin").agg(F.avg("v").alias("gm"))
    total = long.join(grand, [*by, "bin"]).groupBy(*by).agg(F.sum(F.pow(F.col("v") - F.col("gm"), 2)).alias("sst"), F.count_distinct("generator").alias("n"))
    between = mean_of.join(grand, [*by, "bin"]).join(k, [*by, "family"]).groupBy(*by).agg(F.sum(F.col("size") * F.pow(F.col("fm") - F.col("gm"), 2)).alias("ssb"), F.count_distinct("family").alias("k"))
    joined = total.join(between, list(by)) if by else total.crossJoin(between)
    ssw = F.col("sst") - F.col("ssb")
    return joined.select(*by, ((F.col("ssb") / (F.col("k") - 1)) / F.greatest(ssw / (F.col("n") - F.col("k")), F.lit(1e-15))).alias("pseudo_f"), (F.col("ssb") / F.col("sst")).alias("r2"))


def centroid_draws(distances: DataFrame, plan: DataFrame) -> DataFrame:
    """(rep, pseudo_f, r2, dispersion_f) of each labelling, centroids recomputed, from pair distances alone.

    ``distances``: (a, b, d2) of all ordered pairs, self pairs too; ``plan``:
    (rep, item, label). A sum of squares is the mean square of pairs, and
    d2(i, centroid) = mean over j of d2(i, j) - half the mean over j, k.
    """
    a = plan.select("rep", "label", F.col("item").alias("a"))
    near = a.join(plan.select("rep", "label", F.col("item").alias("b")), ["rep", "label"]).join(F.broadcast(distances), ["a", "b"])
    sums = near.groupBy("rep", "label", "a").agg(F.count("*").alias("n"), F.sum("d2").alias("s"))
    family = sums.groupBy("rep", "label").agg(F.count("*").alias("n"), F.sum("s").alias("t"), F.array_sort(F.collect_list("s")).alias("s"))
    half = F.col("t") / (2 * F.col("n") * F.col("n"))
    family = family.withColumn("d", F.transform("s", lambda s: F.sqrt(F.greatest(s / F.col("n") - half, F.lit(0.0)))))
    family = family.withColumn("m", V.total(F.col("d")) / F.col("n"))
    family = family.withColumn("within", V.total(F.transform("d", lambda d: (d - F.col("m")) * (d - F.col("m")))))
    n, m = F.col("n"), F.col("m")
    out = family.groupBy("rep").agg(F.sum(n).alias("n"), F.count("*").alias("k"), F.sum(F.col("t") / (2 * n)).alias("ssw"), F.sum("within").alias("dw"), F.sum(n * m).alias("s1"), F.sum(n * m * m).alias("s2"))
    total = distances.agg((F.sum("d2") / (2 * F.count_distinct("a"))).alias("sst"))
    between, rest = F.greatest(F.col("k") - 1, F.lit(1)), F.greatest(F.col("n") - F.col("k"), F.lit(1))
    f = lambda b, w: (b / between) / F.greatest(w / rest, F.lit(1e-15))
    ssb = F.col("sst") - F.col("ssw")
    return out.join(F.broadcast(total)).select("rep", f(ssb, F.col("ssw")).alias("pseudo_f"), (ssb / F.greatest("sst", F.lit(1e-15))).alias("r2"), f(F.col("s2") - F.col("s1") * F.col("s1") / F.col("n"), F.col("dw")).alias("dispersion_f"))


def dispersion_f(long: DataFrame) -> DataFrame:
    """One-way F of the distances to the own family's mean."""
    centre = long.groupBy("family", "bin").agg(F.avg("v").alias("c"))
    away = long.join(centre, ["family", "bin"]).groupBy("generator", "family").agg(F.sqrt(F.sum(F.pow(F.col("v") - F.col("c"), 2))).alias("d"))
    stats = away.groupBy("family").agg(F.avg("d").alias("m"), F.count("*").alias("n"), F.var_pop("d").alias("var"))
    out = stats.agg(F.sum("n").alias("n"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"), F.sum(F.col("n") * F.col("var")).alias("ssw"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("s2"))
    ssb = F.col("s2") - F.col("n") * F.col("gm") * F.col("gm")
    return out.select(((ssb / (F.col("k") - 1)) / (F.col("ssw") / (F.col("n") - F.col("k")))).alias("dispersion_f"), "n", "k")


def fold_profiles(cells: DataFrame, least: int = 2) -> DataFrame:
    """(fold, generator, family, held, bin, v): adjusted profiles with each generator held out in turn.

    Training cells are adjusted without the held-out generator; the held-out
    one is adjusted by the training cells of its languages.
    """
    folds = cells.agg(F.array_sort(F.collect_set("generator")).alias("folds"))  # one row: the generators
    row = F.array_sort(F.collect_list(F.struct("v", "generator", "family"))).alias("all")
    rows = cells.groupBy("language", "bin").agg(row).join(F.broadcast(folds))

    def middle(kept):
        n = F.size(kept)
        at = lambda i: F.get(kept, i.cast("int"))["v"]
        return F.when(n >= least, (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2)

    # A bin's values stand sorted in one row, so a reference is the middle of what is left without two of them.
    own = rows.select("language", "bin", "folds", "all", F.explode("all").alias("x"))
    each = own.select("bin", "x", F.explode("folds").alias("fold"), "all")
    ref = V.let(F.filter("all", lambda o: (o["generator"] != F.col("x.generator")) & (o["generator"] != F.col("fold"))), middle)
    found = each.select("fold", F.col("x.generator").alias("generator"), F.col("x.family").alias("family"), "bin", (F.col("x.v") - ref).alias("v")).where("v is not null")
    out = found.groupBy("fold", "generator", "family", "bin").agg(F.median("v").alias("v"))
    return out.withColumn("held", F.col("fold") == F.col("generator"))


def logo_scores(folds: DataFrame) -> DataFrame:
    """(fold, true, family, score): cosine of the held-out profile to each family's prototype."""
    fitted = P.robust_scale(folds.where("not held").select("fold", "bin", "v"), "fold")
    z = P.scaled(folds, fitted, "fold")
    arrays = P.arrays(z, "fold", "generator", "family", "held").withColumn("z", V.l2_normalised(F.col("r")))
    train = arrays.where("not held").select("fold", "family", F.posexplode("z").alias("bin", "v"))
    proto = P.arrays(train.groupBy("fold", "family", "bin").agg(F.median("v").alias("v")), "fold", "family").withColumn("p", V.l2_normalised(F.col("r")))
    test = arrays.where("held").select("fold", F.col("family").alias("true"), "z")
    return test.join(proto.select("fold", "family", "p"), "fold").select("fold", "true", "family", V.dot(F.col("z"), F.col("p")).alias("score"))


def logo_predictions(scores: DataFrame) -> DataFrame:
    """The family of the highest score, the first in order on ties."""
    best = scores.groupBy("fold", "true").agg(F.min(F.struct((-F.round("score", 12)).alias("s"), F.col("family"))).alias("b"))
    return best.select("fold", "true", F.col("b.family").alias("predicted"))


def logo_draws(arrays: DataFrame, plan: DataFrame) -> DataFrame:
    """(rep, fold, true, predicted) under each labelling; folds and their adjustment stay as they are.

    ``arrays``: (fold, generator, held, z), scaled and normalised; ``plan``: (rep, generator, family).
    """
    labelled = arrays.join(F.broadcast(plan), "generator")
    # A family's training profiles are a few dozen arrays: their median is taken inside one row, not by a group for each bin.
    train = labelled.where("not held").groupBy("rep", "fold", "family").agg(F.collect_list("z").alias("all"))
    proto = train.select("rep", "fold", "family", V.l2_normalised(V.median_of(F.col("all"))).alias("p"))
    test = labelled.where("held").select("rep", "fold", F.col("family").alias("true"), "z")
    scores = test.join(proto, ["rep", "fold"]).select("rep", "fold", "true", "family", V.dot(F.col("z"), F.col("p")).alias("score"))
    best = scores.groupBy("rep", "fold", "true").agg(F.min(F.struct((-F.round("score", 12)).alias("s"), F.col("family"))).alias("b"))
    return best.select("rep", "fold", "true", F.col("b.family").alias("predicted"))


def _block_matrices(blocks: DataFrame) -> DataFrame:
    """(generator, n_blocks, m): each generator's blocks in order as one array of arrays."""
    held = P.arrays(blocks, "generator", "n_blocks", "block").groupBy("generator", "n_blocks")
    return held.agg(F.array_sort(F.collect_list(F.struct("block", "r"))).alias("m")).select("generator", "n_blocks", F.col("m.r").alias("m"))


def _redrawn(items: Column) -> Column:
    """Median of the blocks of ``m`` at the given positions, repeated ones counted as often."""
    return V.let(F.transform(items, lambda i: F.get(F.col("m"), i.cast("int"))), V.median_of)


def redrawn_blocks(blocks: DataFrame, plan: DataFrame) -> DataFrame:
    """(generator, rep, rho, rmse): medians of redrawn blocks against those of all.

    ``blocks``: (generator, n_blocks, block, bin, v); ``plan``: (n_blocks, rep, items).
    """
    matrices = _block_matrices(blocks).withColumn("full", V.median_of(F.col("m")))
    drawn = plan.join(F.broadcast(matrices), "n_blocks")
    both = V.let(_redrawn(F.col("items")), lambda r: F.struct(V.pearson(r, F.col("full")).alias("rho"), V.rmse(r, F.col("full")).alias("rmse")))
    return drawn.select("generator", "rep", both.alias("s")).select("generator", "rep", "s.rho", "s.rmse")


def split_halves(blocks: DataFrame, plan: DataFrame) -> DataFrame:
    """(rep, delta): same-generator less other-generator likeness of half profiles.

    ``blocks``: (generator, n_blocks, block, bin, v); ``plan``: (n_blocks, rep,
    items), permutations of the blocks; the first half is A.
    """
    drawn = plan.join(F.broadcast(_block_matrices(blocks)), "n_blocks")
    half = F.floor(F.col("n_blocks") / 2).cast("int")
    a = drawn.select("rep", F.col("generator").alias("ga"), _redrawn(F.slice("items", F.lit(1), half)).alias("ra"))
    b = drawn.select("rep", F.col("generator").alias("gb"), _redrawn(F.slice("items", half + 1, F.col("n_blocks").cast("int"))).alias("rb"))
    likeness = a.join(b, "rep").select("rep", (F.col("ga") == F.col("gb")).alias("same"), V.pearson(F.col("ra"), F.col("rb")).alias("rho"))
    return likeness.groupBy("rep").agg((F.avg(F.when(F.col("same"), F.col("rho"))) - F.avg(F.when(~F.col("same"), F.col("rho")))).alias("delta"), F.min(F.when(F.col("same"), F.col("rho"))).alias("least_same"))


def block_prototypes(blocks: DataFrame, least: int = 4) -> DataFrame:
    """(generator, block, bin, p): median of the generator's other blocks."""
    other = blocks.select("generator", F.col("block").alias("ob"), "bin", F.col("v").alias("ov"))
    joined = blocks.select("generator", "block", "bin").join(other, ["generator", "bin"]).where("ob <> block")
    return joined.groupBy("generator", "block", "bin").agg(F.median("ov").alias("p"), F.count_distinct("ob").alias("n")).where(F.col("n") >= least - 1).drop("n")


def checkpoint_contrast(left: DataFrame, right: DataFrame, metric: Column, tag: str = "tag") -> DataFrame:
    """Same checkpoint over two corpora less different ones, both orientations. ``metric`` reads ra and rb."""
    a, b = left.select(F.col(tag).alias("ta"), F.col("r").alias("ra")), right.select(F.col(tag).alias("tb"), F.col("r").alias("rb"))
    all_pairs = a.join(b).select("ta", "tb", metric.alias("m"))
    sides = all_pairs.where("ta = tb").select(F.col("ta").alias(tag), F.lit(True).alias("same"), "m")
    for side in ("ta", "tb"):
        sides = sides.unionByName(all_pairs.where("ta <> tb").select(F.col(side).alias(tag), F.lit(False).alias("same"), "m"))
    return sides.groupBy(tag).agg(F.avg(F.when(F.col("same"), F.col("m"))).alias("same"), F.avg(F.when(~F.col("same"), F.col("m"))).alias("different")).withColumn("delta", F.col("same") - F.col("different"))


#: Metrics whose smaller value is the closer one.
ERRORS = ("rmse", "mae", "wasserstein_hz")


def profile_metrics(a: Column, b: Column, hz: Column) -> dict[str, Column]:
    """The ten likenesses and distances of two profiles."""
    top = lambda q: V.jaccard(V.threshold_bins(a, q), V.threshold_bins(b, q))
    return {
        "pearson": V.pearson(a, b), "cosine": V.cosine(a, b), "spearman": V.spearman(a, b), "rmse": V.rmse(a, b), "mae": V.mae(a, b),
        "jaccard_top10": top(0.9), "signed_jaccard_top10": V.signed_jaccard(a, b, 0.9), "jaccard_top5": top(0.95), "jaccard_top15": top(0.85), "wasserstein_hz": V.wasserstein(a, b, hz),
    }


def checkpoint_metrics(left: DataFrame, right: DataFrame, hz: Column, tag: str = "tag") -> DataFrame:
    """(tag, metric, same, different, delta) of all ten metrics; a positive delta always means that the same checkpoint is closer.

    Every pair's metrics are computed once and serve both of its checkpoints.
    """
    a, b = left.select(F.col(tag).alias("ta"), F.col("r").alias("ra")), right.select(F.col(tag).alias("tb"), F.col("r").alias("rb"))
    named = profile_metrics(F.col("ra"), F.col("rb"), hz)
    pairs = a.join(b).select("ta", "tb", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("m")) for k, v in named.items()])).alias("x")).select("ta", "tb", "x.metric", "x.m")
    sides = pairs.select("metric", "m", (F.col("ta") == F.col("tb")).alias("same"), F.explode(F.array_distinct(F.array("ta", "tb"))).alias(tag))
    out = sides.groupBy(tag, "metric").agg(F.avg(F.when(F.col("same"), F.col("m"))).alias("same"), F.avg(F.when(~F.col("same"), F.col("m"))).alias("different"))
    sign = F.when(F.col("metric").isin(*ERRORS), -1.0).otherwise(1.0)
    return out.withColumn("delta", sign * (F.col("same") - F.col("different")))


def group_effects(deltas: DataFrame, *by: str) -> DataFrame:
    """Over checkpoints: n, mean and median delta, how many are positive, zero and negative, and the least p that all sign flips can give."""
    d = F.col("delta")
    return deltas.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("mean_delta"), F.median(d).alias("median_delta"), F.count_if(d > 0).alias("positive"), F.count_if(d == 0).alias("zero"), F.count_if(d < 0).alias("negative"), F.pow(F.lit(2.0), -F.count(d)).alias("least_p"))


def redrawn_rows(rows: DataFrame, repeats: int, seed: int, tag: str = "tag") -> DataFrame:
    """(tag, side, rep, r): bin-wise medians of rows drawn again with replacement, ``repeats`` times, for sides 0 and 1.

    ``rows``: (tag, side, item, embedding). A tag's draws come from one
    generator, seeded by the tag, that serves side 0 and side 1 in turn. Work is
    dealt out by bin: a task holds one bin of one tag and side, and replays
    the tag's draws.
    """
    import numpy as np
    import pyarrow as pa

    from loomvec.plans.tables import seed_of

    long = rows.select(F.col(tag).cast("string").alias("tag"), "side", "item", F.posexplode("embedding").alias("bin", "v"))
    bins = long.groupBy("tag", "side", "bin").agg(F.array_sort(F.collect_list(F.struct("item", F.col("v").cast("double").alias("v")))).alias("s")).select("tag", "side", "bin", F.col("s.v").alias("v"))
    sizes = rows.groupBy(F.col(tag).cast("string").alias("tag")).agg(F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1")).where("n0 > 0 and n1 > 0")

    def run(batches):
        for records in batches:
            tags, sides = records.column(0).to_pylist(), records.column(1).to_numpy()
            made = np.empty((records.num_rows, repeats))
            for name in dict.fromkeys(tags):  # rows come sorted by tag, so a tag's draws are replayed once for many of its bins
                own = [i for i, t in enumerate(tags) if t == name]
                n = [records.column(c)[own[0]].as_py() for c in (4, 5)]
                values = {i: records.column(3)[i].values.to_numpy() for i in own}
                rng = np.random.default_rng(seed_of("content_boot", name, seed))
                at = [[i for i in own if sides[i] == side] for side in (0, 1)]
                stacked = [np.stack([values[i] for i in rows]) if rows else None for rows in at]
                for rep in range(repeats):
                    draws = [rng.choice(k, size=k, replace=True) for k in n]
                    for rows, block, picked in zip(at, stacked, draws, strict=True):
                        if rows:
                            made[rows, rep] = np.median(block[:, picked], axis=1)
            yield pa.RecordBatch.from_arrays([*(records.column(i) for i in range(3)), pa.array(list(made), pa.list_(pa.float64()))], names=["tag", "side", "bin", "medians"])

    drawn = bins.join(F.broadcast(sizes), "tag").select("tag", "side", "bin", "v", "n0", "n1").repartition("tag", "bin").sortWithinPartitions("tag").mapInArrow(run, "tag string, side int, bin int, medians array<double>")
    return P.arrays(drawn.select("tag", "side", "bin", F.posexplode("medians").alias("rep", "v")), "tag", "side", "rep")


def negative_pairs(pairs: DataFrame, spectra: DataFrame, partners: DataFrame, first: int, size: int, folds: int, seed: int) -> DataFrame:
    """Per pair: its residual and the one against a wrong original, by size and by likeness to the cross-fitted prototype.

    ``pairs``: (pair_id, original, generator, language, offset, r), ``spectra``:
    (original, s), ``partners``: (original, partner). The wrong residual is the
    pair's generated spectrum less the partner's, centred over the band. The
    prototype is the median over the generator's and language's pairs outside
    the original's fold; a pair without any is left out.
    """
    placed = pairs.withColumn("fold", (seed_hex16(F.lit("proto"), F.col("original"), F.lit(seed)) % folds).cast("int"))
    others = placed.withColumn("outside", F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: k != F.col("fold")))).select("generator", "language", F.col("outside").alias("fold"), "r")
    proto = P.arrays(P.bin_medians(P.long_view(others, "r", "generator", "language", "fold"), "generator", "language", "fold"), "generator", "language", "fold").withColumnRenamed("r", "p")
    own, other = spectra.select("original", F.col("s").alias("own")), spectra.select(F.col("original").alias("partner"), F.col("s").alias("other"))
    joined = placed.join(partners, "original").join(own, "original").join(other, "partner").join(proto, ["generator", "language", "fold"])
    raw = F.zip_with(F.transform("r", lambda x: x + F.col("offset")), F.zip_with("own", "other", lambda x, y: x - y), lambda x, y: x + y)
    wrong = V.let(raw, lambda w: V.let(V.median(F.slice(w, first + 1, size)), lambda m: F.transform(w, lambda x: x - m)))
    rms = lambda a: F.sqrt(V.dot(a, a) / F.size(a))
    made = joined.withColumn("wrong", wrong)
    return made.select("pair_id", "original", "generator", "language", "partner", rms(F.col("r")).alias("paired_rms"), rms(F.col("wrong")).alias("mismatched_rms"), V.pearson(F.col("r"), F.col("p")).alias("paired_corr"), V.pearson(F.col("wrong"), F.col("p")).alias("mismatched_corr"))


def framed(df: DataFrame, signal: str, size: int, hop: int, *keys: str) -> DataFrame:
    """(keys, frame, x): whole frames of a signal array; a short signal is padded with zeros to one."""
    n = F.size(signal)
    padded = F.when(n < size, F.concat(F.col(signal), F.array_repeat(F.lit(0.0), F.lit(size) - n))).otherwise(F.col(signal))
    starts = F.sequence(F.lit(0), F.greatest(n, F.lit(size)) - size, F.lit(hop))
    exploded = df.select(*keys, padded.alias("s"), F.posexplode(starts).alias("frame", "start"))
    return exploded.select(*keys, "frame", F.slice("s", F.col("start") + 1, F.lit(size)).alias("x"))


def active_frames(frames: DataFrame, *keys: str, top_db: float = 40.0, floor_db: float = -80.0, least: int = 3) -> DataFrame:
    """Frames with ``db`` and ``active``: within top_db of the 95th percentile, or the loudest ``least``."""
    level = F.sqrt(V.total(F.transform("x", lambda v: v * v)) / F.size("x"))
    measured = frames.withColumn("rms", level).withColumn("db", 20 * F.log10(F.col("rms") + 1e-12))
    cut = measured.groupBy(*keys).agg(F.greatest(F.percentile("db", 0.95) - top_db, F.lit(floor_db)).alias("cut"))
    joined = measured.join(cut, list(keys)).withColumn("loud", F.col("db") >= F.col("cut"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("rms").desc(), F.col("frame").desc()))
    enough = F.count_if(F.col("loud")).over(Window.partitionBy(*keys)) >= least
    return joined.withColumn("active", F.when(enough, F.col("loud")).otherwise(rank <= least)).drop("loud", "x")
