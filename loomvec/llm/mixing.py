"""Mixing sources to target weights by entropy balancing.

The rates r of the documents minimise the entropy distance
``sum(size * (r * ln r - r + 1))`` from the corpus as it is, under one token
constraint for each source, ``sum(size * r) = target``, under ``r <= cap``,
and under two that all documents share: the mix keeps the corpus's
distribution of document lengths, by the mean and the spread of the log size
over tokens. These two are held by a ridge, so that there is always a
solution. The dual is convex in one multiplier for each source and two shared
ones, and the rates are tilted exponentially:
``r = min(cap, exp(lambda[source] + beta . features(size)))``.

Newton's iterations solve the dual. Each takes value, gradient and Hessian
from one distributed aggregation; documents of one size class of a source have
the same features, so the sums run over these cells, which are counted once
with a map-side combine. Only the source block of the Hessian grows, and that
is diagonal: it is eliminated source by source, and the driver solves the two
by two system that is left. A step that doesn't lower the dual is halved.

The rates are then rounded into copies. Within a cell the documents that get
one more copy are spread evenly over a fixed order; from cell to cell, by
descending size, the rounding error is carried on, so that a source's taken
words end within about half of one of its smallest documents. A cell of many
rows is numbered in hash buckets with known offsets: no task holds a whole
source, and every row is numbered.

Size classes keep the seven leading bits of a size, so a source has fewer
than 64 classes for each doubling of the longest document, whatever the number
of documents. All is DataFrame expressions.

Defined cases: a null text has size 0 and is taken 0 times; a null source is a
source of its own, last in order; sources without words have target 0; a
source whose target is the cap times its size is taken so often as a whole;
repeated rows and equal or null ids are separate documents; an empty table
gives no rows; results don't depend on partitioning; no column of the input
clashes with an inner one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomvec.session import materialize, setting

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
BUCKET_ROWS = 1 << 9
#: Weight of the penalty on the shared multipliers, for each token of the mix.
RIDGE = 0.01
STEPS, TOLERANCE = 60, 1e-9
#: Most that a shared multiplier moves in a step.
REACH = 8.0
#: Rows that are broadcast at most; beyond that a shuffle join is used.
BROADCAST_ROWS = 1 << 17


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null has none."""
    flat = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.array_remove(F.split(flat, " "), "")), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """The size with all but its seven leading bits cleared."""
    drop = F.greatest(F.lit(0), F.length(F.bin(size)) - F.lit(7))
    return F.call_function("shiftleft", F.call_function("shiftright", size, drop.cast("int")), drop.cast("int"))


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``target`` for rows (source, source_size).

    Sources by code point, null last, take the weights in turn and share
    ``share`` of all sizes. A target stops at ``cap`` times its source; the
    excess goes to the others by weight until none is above. Written as water
    filling: with the sources by ascending cap / weight, those below the first
    level that holds for the rest are at their cap.
    """
    n = len(weights)
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(n)) + 1).cast("int"))
    rows = sources.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    rows = rows.withColumn("level", level).withColumn("place", F.row_number().over(order))
    holds = F.min(F.when(F.col("level") * F.col("w") <= F.col("most"), F.struct("place", "level"))).over(everything)
    final = F.coalesce(holds["level"], F.lit(float("inf")))
    return rows.select("source", "source_size", F.least(F.col("most"), final * F.col("w")).alias("target"))


def _exact(x: Column) -> Column:
    """A sum that doesn't depend on the order of the rows."""
    return F.coalesce(F.sum(x.cast("decimal(38,12)")).cast("double"), F.lit(0.0))


def with_features(cells: DataFrame) -> DataFrame:
    """``cells`` (words, c) with z, the standardised log size over tokens, and q = z * z - 1; both average 0 over the corpus."""
    log = F.log(F.greatest(F.col("c"), F.lit(1)).cast("double"))
    seen = cells.agg(_exact(F.col("words")).alias("n"), _exact(F.col("words") * log).alias("s")).first()
    mean = seen["s"] / seen["n"] if seen["n"] else 0.0
    variance = cells.agg(_exact(F.col("words") * (log - mean) * (log - mean)).alias("v")).first()["v"] / max(seen["n"], 1.0)
    z = (log - mean) / variance**0.5 if variance > 1e-9 else F.lit(0.0)
    return cells.withColumn("z", z).withColumn("q", F.col("z") * F.col("z") - 1.0 if variance > 1e-9 else F.lit(0.0))


def rate(multiplier: Column, beta: tuple[float, float], z: Column, q: Column, fixed: Column, cap: float) -> Column:
    """The tilted rate; ``fixed`` where a source isn't free."""
    return F.coalesce(fixed, F.least(F.lit(cap), F.exp(multiplier + beta[0] * z + beta[1] * q)))


def _sums(cells: Column, multiplier: Column, beta: tuple[float, float], fixed: Column, cap: float) -> Column:
    """Over one source's cells: tokens taken, their moments, the Hessian's entries and the dual's value."""
    names = ("a", "m1", "m2", "h", "h1", "h2", "h11", "h12", "h22", "value")

    def add(s, cell):
        w, z, q = cell["w"].cast("double"), cell["z"], cell["q"]
        t = multiplier + beta[0] * z + beta[1] * q
        over = F.log(F.lit(cap)) <= t
        r = rate(multiplier, beta, z, q, fixed, cap)
        h = F.when(fixed.isNull() & ~over, w * r).otherwise(F.lit(0.0))
        value = F.when(fixed.isNotNull(), w * r * (t - multiplier)).when(over, w * cap * (1.0 + t - F.log(F.lit(cap)))).otherwise(w * r)
        terms = (w * r, w * r * z, w * r * q, h, h * z, h * q, h * z * z, h * z * q, h * q * q, value)
        return F.struct(*[(s[k] + x).alias(k) for k, x in zip(names, terms, strict=True)])

    return F.aggregate(cells, F.struct(*[F.lit(0.0).alias(k) for k in names]), add)


def balance(sources: DataFrame, *, cap: float = CAP, ridge: float = RIDGE, steps: int = STEPS, tolerance: float = TOLERANCE) -> tuple[DataFrame, tuple[float, float]]:
    """The dual's solution: ``sources`` (source, source_size, target, cells) with multiplier and fixed, and beta.

    ``fixed`` is a source's rate where its constraint leaves no choice, else
    null. Should the iterations not settle, the shared constraints are given up
    and each source gets one rate, which meets its own.

    The iterations' tables have a row for each source, so their plans aren't
    compiled: every step has other numbers and would leave code behind.
    """
    with setting(sources.sparkSession, "spark.sql.codegen.wholeStage", "false"):
        return _balance(sources, cap, ridge, steps, tolerance)


def _balance(sources: DataFrame, cap: float, ridge: float, steps: int, tolerance: float) -> tuple[DataFrame, tuple[float, float]]:
    size, target = F.col("source_size").cast("double"), F.col("target")
    fixed = F.when((target <= 0) | (size <= 0), F.lit(0.0)).when(target >= cap * size * (1 - 1e-12), F.lit(cap))
    state = sources.withColumn("fixed", fixed).withColumn("at", F.when(fixed.isNull(), F.log(target / size)).otherwise(F.lit(0.0))).withColumn("move", F.lit(0.0))
    state = materialize(state, "balance", small=True)
    words = state.agg(_exact(target).alias("n")).first()["n"]
    at, move, t, best = (0.0, 0.0), (0.0, 0.0), 1.0, None
    for _ in range(steps):
        beta = (at[0] + t * move[0], at[1] + t * move[1])
        here = F.col("at") + F.lit(t) * F.col("move")
        now = state.withColumn("here", here)
        now = now.withColumn("s", _sums(F.col("cells"), F.col("here"), beta, F.col("fixed"), cap))
        free = F.col("fixed").isNull()
        off = F.when(free, F.col("s.a") - target).otherwise(F.lit(0.0))
        now = now.withColumn("off", off).withColumn("inverse", F.when(F.col("s.h") > 0, 1 / F.col("s.h")).otherwise(F.lit(0.0)))
        now = materialize(now, "newton", small=True)
        cross = lambda i, j: _exact(F.col(f"s.h{i}{j}") - F.col(f"s.h{i}") * F.col(f"s.h{j}") * F.col("inverse"))
        slope = lambda i: _exact(F.col(f"s.m{i}") - F.col(f"s.h{i}") * F.col("off") * F.col("inverse"))
        seen = now.agg(
            _exact(F.col("s.value") - F.when(free, F.col("here") * target).otherwise(F.lit(0.0))).alias("value"), cross(1, 1).alias("c11"), cross(1, 2).alias("c12"), cross(2, 2).alias("c22"), slope(1).alias("g1"), slope(2).alias("g2"),
            _exact(F.col("s.m1")).alias("m1"), _exact(F.col("s.m2")).alias("m2"), F.coalesce(F.max(F.abs("off") / F.greatest(target, F.lit(1.0))), F.lit(0.0)).alias("off"),
        ).first()
        value = seen["value"] + ridge * words / 2 * (beta[0] ** 2 + beta[1] ** 2)
        if best is not None and value > best + 1e-11 * words and t > 1e-6:
            t /= 2
            continue
        held = max(abs(seen["m1"] + ridge * words * beta[0]), abs(seen["m2"] + ridge * words * beta[1]))
        solved = now.withColumn("multiplier", F.col("here")).select("source", "source_size", "target", "cells", "multiplier", "fixed")
        if seen["off"] <= tolerance and held <= tolerance * max(words, 1.0):
            return solved, beta
        best = value
        g1, g2 = seen["g1"] + ridge * words * beta[0], seen["g2"] + ridge * words * beta[1]
        c11, c12, c22 = seen["c11"] + ridge * words, seen["c12"], seen["c22"] + ridge * words
        det = c11 * c22 - c12 * c12
        move = ((c12 * g2 - c22 * g1) / det, (c12 * g1 - c11 * g2) / det)
        long = max(abs(move[0]) / REACH, abs(move[1]) / REACH, 1.0)
        move = (move[0] / long, move[1] / long)
        newton = -(F.col("off") + F.col("s.h1") * move[0] + F.col("s.h2") * move[1]) * F.col("inverse")
        # A source all of whose cells are at the cap has no curvature: it is taken down step by step.
        step = F.when(~free, F.lit(0.0)).when(F.col("s.h") > 0, newton).otherwise(-0.5 * F.signum("off"))
        state = now.withColumn("at", F.col("here")).withColumn("move", step).select("source", "source_size", "target", "cells", "fixed", "at", "move")
        at, t = beta, 1.0
    plain = F.when(fixed.isNull(), F.log(target / size)).otherwise(F.lit(0.0))
    return sources.withColumn("fixed", fixed).withColumn("multiplier", plain), (0.0, 0.0)


def mix(docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, keep: bool = False, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken for every document.

    ``keep``: with all columns of ``docs`` besides ``copies``; a column of that
    name in ``docs`` gives way.
    """
    # Ids, sources and sizes are kept once, so that the texts aren't counted again for each use.
    size = word_count(F.col("text").cast("string"))
    own = [F.col("doc_id"), F.col("source"), size.alias("size"), size_class(size).alias("c"), F.xxhash64("doc_id", "text").alias("mark")]
    slim = materialize(docs.select(*own), "sizes")
    sized = docs.select(*own, F.struct(*[F.col(x) for x in docs.columns if x != "copies"]).alias("row")) if keep else slim
    cells = with_features(materialize(slim.groupBy("source", "c").agg(F.count("*").alias("rows"), F.sum("size").alias("words")), "cells", small=True))
    cell = F.struct("c", F.col("rows").alias("n"), F.col("words").alias("w"), "z", "q")
    sources = cells.groupBy("source").agg(F.sum("words").alias("source_size"), F.sort_array(F.collect_list(cell), asc=False).alias("cells"))
    targets = source_targets(sources.select("source", "source_size"), weights, share, cap).select(F.col("source").alias("of"), "target")
    solved, beta = balance(sources.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of"), cap=cap)
    rated = solved.select("source", "source_size", "target", F.transform("cells", lambda x: F.struct(x["c"].alias("c"), x["n"].alias("n"), x["w"].alias("w"), F.round(rate(F.col("multiplier"), beta, x["z"], x["q"], F.col("fixed"), cap), 9).alias("r"))).alias("cells"))

    def carried(state, cell):
        base = F.floor(cell["r"]).cast("long")
        part, mean = cell["r"] - base, cell["w"] / cell["n"]
        want = part * cell["w"] + state["over"]
        zero = F.lit(0).cast("long")
        more = F.when((mean > 0) & (part > 0), F.least(cell["n"], F.greatest(zero, F.round(want / mean).cast("long")))).otherwise(zero)
        return F.struct((want - more * mean).alias("over"), F.concat(state["done"], F.array(F.struct(cell["c"].alias("c"), cell["n"].alias("n"), base.alias("base"), more.alias("more")))).alias("done"))

    start = F.struct(F.lit(0.0).alias("over"), F.expr("cast(array() as array<struct<c:bigint,n:bigint,base:bigint,more:bigint>>)").alias("done"))
    plan = rated.select("source", "source_size", "target", F.explode(F.aggregate("cells", start, carried)["done"]).alias("cell"))
    plan = plan.select(F.col("source").alias("p_source"), F.col("cell.c").alias("p_c"), "source_size", "target", "cell.base", "cell.n", "cell.more", F.ceil(F.col("cell.n") / F.lit(bucket_rows)).alias("buckets"))
    # The plan has a row for each source and size class; it is sent to all only while that is few.
    plan = materialize(plan, "plan", small=True)
    of_cell = F.col("source").eqNullSafe(F.col("p_source")) & (F.col("c") == F.col("p_c"))
    placed = sized.join(plan if plan.count() > BROADCAST_ROWS else F.broadcast(plan), of_cell)
    bucket = F.pmod(F.xxhash64("doc_id", "mark"), F.col("buckets"))
    placed = placed.withColumn("bucket", bucket)
    # Offsets of the buckets, for cells of more than one bucket only.
    many = slim.join(plan.where("buckets > 1").select("p_source", "p_c", "buckets"), of_cell)
    many = many.groupBy("p_source", "p_c", bucket.alias("o_bucket")).agg(F.count("*").alias("rows"))
    before = Window.partitionBy("p_source", "p_c").orderBy("o_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = many.select(F.col("p_source").alias("o_source"), F.col("p_c").alias("o_c"), "o_bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    offsets = materialize(offsets, "offsets", small=True)
    placed = placed.join(offsets if offsets.count() > BROADCAST_ROWS else F.broadcast(offsets), F.col("p_source").eqNullSafe(F.col("o_source")) & (F.col("p_c") == F.col("o_c")) & (F.col("bucket") == F.col("o_bucket")), "left")
    rank = F.row_number().over(Window.partitionBy("p_source", "p_c", "bucket").orderBy("size", "doc_id", "mark")) - 1 + F.coalesce("offset", F.lit(0))
    placed = placed.withColumn("rank", rank.cast("long"))
    one_more = F.floor((F.col("rank") + 1) * F.col("more") / F.col("n")) > F.floor(F.col("rank") * F.col("more") / F.col("n"))
    copies = F.when(F.col("size") > 0, F.col("base") + one_more.cast("long")).otherwise(F.lit(0).cast("long"))
    if keep:
        return placed.select("row.*", copies.alias("copies"))
    return placed.withColumn("copies", copies).select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
