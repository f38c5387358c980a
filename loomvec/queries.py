"""Queries over the driver's tables, with DuckDB SQL for each that SQL can express.

``embeddings`` stands for recordings: generator = label, language = vec_id % 4,
family = label % 4; ``documents`` for hashed files; ``lineitem`` and ``orders``
for manifests; ``events`` for signals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomvec.functions import hashing as H
from loomvec.functions import text as T
from loomvec.functions import vectors as V
from loomvec.operators import analysis as A
from loomvec.operators import inference as I
from loomvec.operators import manifest as M
from loomvec.operators import profiles as P
from loomvec.session import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Hz of a bin of the 64-bin fixture, and its band's first bin and size.
HZ, BAND_FIRST, BAND_SIZE = 125.0, 1, 60


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(c: str | F.Column, name: str | None = None) -> F.Column:
    column = F.col(c) if isinstance(c, str) else c
    return (F.round(column, 6) + F.lit(0.0)).alias(name or str(c))


# -- shared inputs ---------------------------------------------------------------


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("label").cast("int").alias("generator"), (F.col("vec_id") % 4).cast("int").alias("language"), (F.col("label") % 4).cast("int").alias("family"), "embedding")


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.long_view(vectors(spark, sf_dir), "embedding", "vec_id", "generator", "language", "family")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").count()  # from the footers
    medians = P.large_medians if rows * 64 > P.LARGE else P.bin_medians
    return medians(long(spark, sf_dir), "generator", "family", "language")


def generator_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.profiles(cells(spark, sf_dir), "generator", "family")


def adjusted_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.adjusted(cells(spark, sf_dir)).groupBy("generator", "family", "bin").agg(F.median("v").alias("v"))


def scaled_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = adjusted_long(spark, sf_dir)
    return P.scaled(x, P.robust_scale(x))


LONG = """
long as (select vec_id, label::int as generator, (vec_id % 4)::int as language, (label % 4)::int as family,
  unnest(range(64))::int as bin, unnest(embedding)::double as v from embeddings)"""
CELLS = LONG + """,
cells as (select generator, family, language, bin, median(v) as v, count(*) as n_pairs from long group by all)"""
PROF = CELLS + """,
prof as (select generator, family, bin, median(v) as v from cells group by all)"""
ADJ = CELLS + """,
ref as (select c.generator, c.language, c.bin, median(o.v) as ref, count(distinct o.generator) as n_reference
  from cells c join cells o on c.language = o.language and c.bin = o.bin and c.generator <> o.generator group by all having count(distinct o.generator) >= 2),
adj as (select c.generator, c.family, c.language, c.bin, c.v - r.ref as v, c.n_pairs, r.n_reference from cells c join ref r using (generator, language, bin)),
aprof as (select generator, family, bin, median(v) as v from adj group by all)"""
SCALED = ADJ + """,
cs as (select bin, median(v) as centre, stddev_samp(v) as sd from aprof group by bin),
md as (select bin, centre, sd, median(abs(v - centre)) * 1.4826 as mad from aprof join cs using (bin) group by all),
fit as (select bin, centre, case when mad > 1e-8 then mad when sd > 1e-8 then sd else 1.0 end as scale from md),
z as (select generator, family, bin, (v - centre) / scale as v from aprof join fit using (bin))"""
PAIRS = PROF + """,
cosines as (select a.generator as generator_a, b.generator as generator_b, any_value(a.family) as family_a, any_value(b.family) as family_b,
  sum(a.v * b.v) / sqrt(sum(a.v * a.v) * sum(b.v * b.v)) as cosine, sqrt(sum((a.v - b.v) * (a.v - b.v))) as euclidean
  from prof a join prof b on a.bin = b.bin and a.generator < b.generator group by 1, 2)"""


# -- profiles ----------------------------------------------------------------------


@query(f"with {CELLS} select generator, family, language, bin, round(v, 6) as v, n_pairs from cells")
def cell_median_profile(spark, sf_dir):
    return cells(spark, sf_dir).select("generator", "family", "language", "bin", r6("v"), "n_pairs")


@query(f"""with {CELLS} select generator, family, bin, round(median(v), 6) as v, count(distinct language) as n_languages, sum(n_pairs)::bigint as n_pairs_total,
  string_agg(distinct language::varchar, '|' order by language::varchar) as languages from cells group by all""")
def generator_profile(spark, sf_dir):
    return cells(spark, sf_dir).groupBy("generator", "family", "bin").agg(r6(F.median("v"), "v"), F.count_distinct("language").alias("n_languages"), F.sum("n_pairs").alias("n_pairs_total"), T.joined_set(F.col("language").cast("string")).alias("languages"))


@query("select bin::int as bin_index, 'res_' || lpad(bin::varchar, 4, '0') as column_name, bin * 15.625::double as frequency_hz, (bin * 15.625 between 80 and 7600) as in_band from range(513) t(bin)")
def frequency_axis(spark, sf_dir):
    from loomvec.spectral import frequency_axis as axis

    return axis(spark)


@query(f"with {LONG} select vec_id, bin, round(v, 6) as v from long where bin * {HZ} between 80 and 7600")
def band_slice(spark, sf_dir):
    x = P.long_view(vectors(spark, sf_dir).select("vec_id", F.slice("embedding", BAND_FIRST + 1, BAND_SIZE).alias("r")), "r", "vec_id")
    return x.select("vec_id", (F.col("bin") + BAND_FIRST).alias("bin"), r6("v"))


@query(f"""with {LONG}, off as (select vec_id, median(v) as offset_db from long where bin * {HZ} between 80 and 7600 group by all)
  select vec_id, bin, round(offset_db, 6) as offset_db, round(v - offset_db, 6) as v from long join off using (vec_id)""")
def centre_residual(spark, sf_dir):
    x = P.centred(vectors(spark, sf_dir).select("vec_id", "embedding"), "embedding", BAND_FIRST, BAND_SIZE)
    return P.long_view(x, "embedding", "vec_id", "offset_db").select("vec_id", "bin", r6("offset_db"), r6("v"))


@query(f"""with {LONG} select vec_id, round(avg(v) filter (bin * {HZ} < 1000), 6) as lf_mean, round(avg(v) filter (bin * {HZ} >= 1000 and bin * {HZ} < 4000), 6) as mf_mean,
  round(avg(v) filter (bin * {HZ} >= 4000 and bin * {HZ} < 8001), 6) as hf_mean, round(sqrt(avg(v * v)), 6) as residual_l2 from long group by all""")
def band_means_rms(spark, sf_dir):
    x = P.band_stats(long(spark, sf_dir), F.col("bin") * F.lit(HZ), "vec_id")
    return x.select("vec_id", *[r6(c) for c in ("lf_mean", "mf_mean", "hf_mean", "residual_l2")])


@query(f"with {ADJ} select generator, language, bin, round(ref, 6) as ref, n_reference from ref")
def language_reference(spark, sf_dir):
    return P.language_reference(cells(spark, sf_dir)).select("generator", "language", "bin", r6("ref"), "n_reference")


@query(f"with {ADJ} select generator, family, language, bin, round(v, 6) as v, n_pairs, n_reference from adj")
def adjusted_cells(spark, sf_dir):
    return P.adjusted(cells(spark, sf_dir)).select("generator", "family", "language", "bin", r6("v"), "n_pairs", "n_reference")


@query(f"with {ADJ} select generator, family, bin, round(v, 6) as v from aprof")
def adjusted_profile(spark, sf_dir):
    return adjusted_long(spark, sf_dir).select("generator", "family", "bin", r6("v"))


@query(f"with {SCALED} select bin, round(centre, 6) as centre, round(scale, 6) as scale from fit")
def robust_scale(spark, sf_dir):
    return P.robust_scale(adjusted_long(spark, sf_dir)).select("bin", r6("centre"), r6("scale"))


@query(f"with {SCALED}, n as (select generator, sqrt(sum(v * v)) as n from z group by all) select generator, family, bin, round(v / case when n <= 1e-12 then 1 else n end, 6) as v from z join n using (generator)")
def l2_normalised_profile(spark, sf_dir):
    x = P.arrays(scaled_long(spark, sf_dir), "generator", "family").withColumn("r", V.l2_normalised(F.col("r")))
    return P.long_view(x, "r", "generator", "family").select("generator", "family", "bin", r6("v"))


@query("select count(*) filter (len(list_filter(embedding, lambda x: isnan(x) or isinf(x))) > 0) as n_not_finite, count(*) as n_rows, min(len(embedding))::int as least_bins, max(len(embedding))::int as most_bins from embeddings")
def finite_values_guard(spark, sf_dir):
    return vectors(spark, sf_dir).agg(F.count_if(~V.is_finite(F.col("embedding"))).alias("n_not_finite"), F.count("*").alias("n_rows"), F.min(F.size("embedding")).alias("least_bins"), F.max(F.size("embedding")).alias("most_bins"))


# -- similarity ----------------------------------------------------------------------


@query(f"with {PAIRS} select generator_a, generator_b, round(cosine, 6) as cosine from cosines")
def pairwise_cosine(spark, sf_dir):
    x = P.pairs(generator_profiles(spark, sf_dir), "generator")
    return x.select("generator_a", "generator_b", r6(V.cosine(F.col("r_a"), F.col("r_b")), "cosine"))


@query(f"""with {PROF}, ranked as (select generator, bin, rank() over (partition by generator order by v) + (count(*) over (partition by generator, v) - 1) / 2.0 as v from prof)
  select a.generator as generator_a, b.generator as generator_b, round(corr(a.v, b.v), 6) as spearman from ranked a join ranked b on a.bin = b.bin and a.generator < b.generator group by 1, 2""")
def pairwise_spearman(spark, sf_dir):
    return similarity(spark, sf_dir).select("generator_a", "generator_b", r6("spearman"))


@query(f"""with {PROF} select a.generator as generator_a, b.generator as generator_b, round(sqrt(sum((a.v - b.v) * (a.v - b.v))), 6) as euclidean, round(sqrt(avg((a.v - b.v) * (a.v - b.v))), 6) as rmse,
  round(avg(abs(a.v - b.v)), 6) as mae, round(corr(a.v, b.v), 6) as pearson from prof a join prof b on a.bin = b.bin and a.generator < b.generator group by 1, 2""")
def pairwise_distances(spark, sf_dir):
    x = P.pairs(generator_profiles(spark, sf_dir), "generator")
    a, b = F.col("r_a"), F.col("r_b")
    return x.select("generator_a", "generator_b", r6(V.euclidean(a, b), "euclidean"), r6(V.rmse(a, b), "rmse"), r6(V.mae(a, b), "mae"), r6(V.pearson(a, b), "pearson"))


TOP = PROF + """,
top as (select generator, bin from (select generator, bin, row_number() over (partition by generator order by abs(v) desc, bin) as k from prof) where k <= 7)"""


@query(f"with {TOP} select generator, bin from top")
def top_fraction_mask(spark, sf_dir):
    return generator_profiles(spark, sf_dir).select("generator", F.explode(V.top_bins(F.col("r"))).alias("bin"))


@query(f"""with {TOP}, common as (select a.generator as ga, b.generator as gb, count(*) as n from top a join top b on a.bin = b.bin and a.generator < b.generator group by 1, 2),
  gens as (select distinct generator from top)
  select a.generator as generator_a, b.generator as generator_b, round(coalesce(n, 0) / (14.0 - coalesce(n, 0)), 6) as jaccard
  from gens a join gens b on a.generator < b.generator left join common on ga = a.generator and gb = b.generator""")
def jaccard_top10(spark, sf_dir):
    x = P.pairs(generator_profiles(spark, sf_dir), "generator")
    return x.select("generator_a", "generator_b", r6(V.jaccard(V.top_bins(F.col("r_a")), V.top_bins(F.col("r_b"))), "jaccard"))


@query(f"""with {PROF}, cut as (select generator, quantile_cont(abs(v), 0.9) as q from prof group by all),
  top as (select generator, bin, sign(v) as s from prof join cut using (generator) where abs(v) >= q),
  n as (select generator, count(*) as n from top group by all),
  common as (select a.generator as ga, b.generator as gb, count(*) as n, count(*) filter (a.s = b.s) as m from top a join top b on a.bin = b.bin and a.generator < b.generator group by 1, 2)
  select a.generator as generator_a, b.generator as generator_b, round(coalesce(c.n, 0)::double / (a.n + b.n - coalesce(c.n, 0)), 6) as jaccard, round(coalesce(c.m, 0)::double / (a.n + b.n - coalesce(c.n, 0)), 6) as signed_jaccard
  from n a join n b on a.generator < b.generator left join common c on ga = a.generator and gb = b.generator""")
def signed_jaccard(spark, sf_dir):
    x = P.pairs(generator_profiles(spark, sf_dir), "generator")
    a, b = F.col("r_a"), F.col("r_b")
    return x.select("generator_a", "generator_b", r6(V.jaccard(V.threshold_bins(a), V.threshold_bins(b)), "jaccard"), r6(V.signed_jaccard(a, b), "signed_jaccard"))


@query(f"""with {PROF}, w as (select generator, bin, abs(v) / sum(abs(v)) over (partition by generator) as w from prof),
  cum as (select generator, bin, sum(w) over (partition by generator order by bin) as c from w)
  select a.generator as generator_a, b.generator as generator_b, round(sum(abs(a.c - b.c)) filter (a.bin < 63) * {HZ}, 4) as wasserstein_hz from cum a join cum b on a.bin = b.bin and a.generator < b.generator group by 1, 2""")
def wasserstein_axis(spark, sf_dir):
    x = P.pairs(generator_profiles(spark, sf_dir), "generator")
    hz = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i * F.lit(HZ))
    return x.select("generator_a", "generator_b", F.round(V.wasserstein(F.col("r_a"), F.col("r_b"), hz), 4).alias("wasserstein_hz"))


@query(f"""with {LONG}, d as (select vec_id, vec_id % 3 as kind, case vec_id % 3 when 0 then 0 when 1 then 2 else v end as a, v as b from long),
  s as (select vec_id, sum(a * b) / nullif(sqrt(sum(a * a) * sum(b * b)), 0) as cosine, case when any_value(kind) < 2 then null else corr(a, b) end as pearson from d group by vec_id)
  select vec_id, round(cosine, 6) as cosine, round(coalesce(cosine, 0), 6) as cosine_zero, round(pearson, 6) as pearson, round(coalesce(pearson, 0), 6) as pearson_zero from s""")
def degenerate_similarity(spark, sf_dir):
    """Vectors against themselves, a third of them made zero and a third constant: null or 0 where a norm or spread is 0."""
    kind = F.col("vec_id") % 3
    x = vectors(spark, sf_dir).select("vec_id", F.transform("embedding", lambda v: F.when(kind == 0, 0.0).when(kind == 1, 2.0).otherwise(v.cast("double"))).alias("a"), F.transform("embedding", lambda v: v.cast("double")).alias("b"))
    a, b = F.col("a"), F.col("b")
    return x.select("vec_id", r6(V.cosine(a, b), "cosine"), r6(V.cosine(a, b, 0.0), "cosine_zero"), r6(V.pearson(a, b), "pearson"), r6(V.pearson(a, b, 0.0), "pearson_zero"))


# -- language persistence (H2) -----------------------------------------------------------


def language_cells(spark, sf_dir):
    return P.arrays(cells(spark, sf_dir), "generator", "language")


H2 = CELLS + """,
rho as (select a.generator as ga, a.language as l1, b.generator as gb, b.language as l2, corr(a.v, b.v) as shape from cells a join cells b on a.bin = b.bin and a.language < b.language group by all),
tops as (select generator, language, bin from (select generator, language, bin, row_number() over (partition by generator, language order by abs(v) desc, bin) as k from cells) where k <= 7),
hits as (select a.generator as ga, a.language as l1, b.generator as gb, b.language as l2, count(*) as n from tops a join tops b on a.bin = b.bin and a.language < b.language group by all),
m as (select rho.*, coalesce(n, 0) / (14.0 - coalesce(n, 0)) as support from rho left join hits using (ga, l1, gb, l2)),
same as (select ga as generator, l1, l2, shape as same_shape, support as same_support from m where ga = gb),
diff as (select s.generator, s.l1, s.l2, avg((x.shape + y.shape) / 2) as diff_shape, avg((x.support + y.support) / 2) as diff_support from same s
  join m x on x.ga = s.generator and x.l1 = s.l1 and x.l2 = s.l2 and x.gb <> s.generator join m y on y.ga = x.gb and y.l1 = s.l1 and y.l2 = s.l2 and y.gb = s.generator
  join same o on o.generator = x.gb and o.l1 = s.l1 and o.l2 = s.l2 group by all),
h2 as (select *, same_shape - diff_shape as delta_shape, same_support - diff_support as delta_support from same join diff using (generator, l1, l2)),
effects as (select generator, count(*) as n_pairs, avg(delta_shape) as shape_effect, avg(delta_support) as support_effect from h2 group by generator)"""


@query(f"with {H2} select generator, l1, l2, round(same_shape, 6) as same_shape, round(diff_shape, 6) as diff_shape, round(delta_shape, 6) as delta_shape, round(same_support, 6) as same_support, round(diff_support, 6) as diff_support, round(delta_support, 6) as delta_support from h2")
def h2_language_pairs(spark, sf_dir):
    x = A.language_pairs(language_cells(spark, sf_dir))
    return x.select("generator", "l1", "l2", *[r6(c) for c in ("same_shape", "diff_shape", "delta_shape", "same_support", "diff_support", "delta_support")])


def h2_effects(spark, sf_dir):
    x = A.language_pairs(language_cells(spark, sf_dir))
    return x.groupBy("generator").agg(F.count("*").alias("n_pairs"), F.avg("delta_shape").alias("shape_effect"), F.avg("delta_support").alias("support_effect"))


@query(f"with {H2} select generator, n_pairs, round(shape_effect, 6) as shape_effect, round(support_effect, 6) as support_effect from effects")
def h2_generator_effects(spark, sf_dir):
    return h2_effects(spark, sf_dir).select("generator", "n_pairs", r6("shape_effect"), r6("support_effect"))


@query(f"""with {H2}, v as (select row_number() over (order by generator) - 1 as i, shape_effect as x from effects), n as (select count(*) as n, avg(x) as mean from v),
  draws as (select mask, avg(case when (mask >> i) & 1 = 1 then -x else x end) as d from range((1 << (select n from n)::int)) t(mask), v group by mask)
  select n::int as n, round(mean, 6) as mean, round(avg((d >= mean - 1e-15)::int), 6) as p from draws, n group by 1, 2, mean""")
def h2_signflip(spark, sf_dir):
    return I.signflip_p(h2_effects(spark, sf_dir), "shape_effect").select("n", r6("mean"), r6("p"))


@query()
def h2_bootstrap(spark, sf_dir):
    from loomvec.plans import tables

    effects = h2_effects(spark, sf_dir)
    items = sorted(r["generator"] for r in effects.select("generator").collect())
    plan = tables.bootstraps(spark, items, 10_000, 20260)
    draws = effects.join(F.broadcast(plan), effects["generator"] == plan["item"]).groupBy("rep").agg(F.avg("shape_effect").alias("shape"), F.avg("support_effect").alias("support"))
    return draws.agg(F.count("*").alias("n_boot"), r6(F.percentile("shape", 0.025), "shape_low"), r6(F.percentile("shape", 0.975), "shape_high"), r6(F.percentile("support", 0.025), "support_low"), r6(F.percentile("support", 0.975), "support_high"))


# -- families (H4) -------------------------------------------------------------------------


def similarity(spark, sf_dir):
    return A.similarity_table(generator_profiles(spark, sf_dir))


@query(f"with {PAIRS} select round(avg(cosine) filter (family_a = family_b), 6) as within, round(avg(cosine) filter (family_a <> family_b), 6) as between, round(avg(cosine) filter (family_a = family_b) - avg(cosine) filter (family_a <> family_b), 6) as delta from cosines")
def family_delta(spark, sf_dir):
    return A.family_delta(similarity(spark, sf_dir)).select(r6("within"), r6("between"), r6("delta"))


JACK = PAIRS + """,
gens as (select distinct generator as left_out from prof),
jack as (select left_out, avg(cosine) filter (family_a = family_b) - avg(cosine) filter (family_a <> family_b) as delta from gens join cosines on generator_a <> left_out and generator_b <> left_out group by all),
obs as (select avg(cosine) filter (family_a = family_b) - avg(cosine) filter (family_a <> family_b) as observed from cosines)"""


@query(f"with {JACK} select left_out, round(delta, 6) as delta from jack")
def family_delta_jackknife(spark, sf_dir):
    return A.jackknife(similarity(spark, sf_dir)).select("left_out", r6("delta"))


@query(f"""with {JACK}, s as (select sqrt((count(*) - 1)::double) * stddev_pop(delta) as se from jack) select round(observed, 6) as observed, round(se, 6) as se,
  round(observed - 1.959963984540054 * se, 6) as low, round(observed + 1.959963984540054 * se, 6) as high from s, obs""")
def family_jackknife_interval(spark, sf_dir):
    table = similarity(spark, sf_dir)
    return A.jackknife_interval(A.jackknife(table), A.family_delta(table)).select(r6("observed"), r6("se"), r6("low"), r6("high"))


@query(f"""with {PAIRS}, f as (select distinct family from prof) select family, round(avg(cosine) filter (family_a = family and family_b = family), 6) as inside,
  round(avg(cosine) filter (family_a <> family_b), 6) as outside, round(avg(cosine) filter (family_a = family and family_b = family) - avg(cosine) filter (family_a <> family_b), 6) as delta
  from f join cosines on family in (family_a, family_b) group by family""")
def family_within_outside(spark, sf_dir):
    return A.within_outside(similarity(spark, sf_dir)).select("family", r6("inside"), r6("outside"), r6("delta"))


@query(f"""with {SCALED}, fm as (select family, bin, avg(v) as fm, count(*) as size from z group by all), gm as (select bin, avg(v) as gm from z group by all),
  sst as (select sum((v - gm) * (v - gm)) as sst, count(distinct generator) as n from z join gm using (bin)), ssb as (select sum(size * (fm - gm) * (fm - gm)) as ssb, count(distinct family) as k from fm join gm using (bin))
  select round((ssb / (k - 1)) / greatest((sst - ssb) / (n - k), 1e-15), 6) as pseudo_f, round(ssb / sst, 6) as r2 from sst, ssb""")
def pseudo_f(spark, sf_dir):
    return A.centroid_f(scaled_long(spark, sf_dir)).select(r6("pseudo_f"), r6("r2"))


@query(f"""with {SCALED}, c as (select family, bin, avg(v) as c from z group by all), d as (select generator, family, sqrt(sum((v - c) * (v - c))) as d from z join c using (family, bin) group by all),
  g as (select avg(d) as gm, count(*) as n from d), f as (select family, avg(d) as m, count(*) as n from d group by all)
  select round((select sum(f.n * (m - gm) * (m - gm)) / (count(*) - 1) from f, g) / ((select sum((d - m) * (d - m)) from d join f using (family)) / ((select n from g) - (select count(*) from f))), 6) as dispersion_f,
  (select n from g) as n, (select count(*) from f) as k""")
def dispersion_f(spark, sf_dir):
    return A.dispersion_f(scaled_long(spark, sf_dir)).select(r6("dispersion_f"), "n", "k")


LOGO = CELLS + """,
folds as (select distinct generator as fold from cells),
aj as (select f.fold, c.generator, c.family, c.language, c.bin, c.v - median(o.v) as v from folds f, cells c join cells o on c.language = o.language and c.bin = o.bin and o.generator <> c.generator
  where o.generator <> f.fold group by f.fold, c.generator, c.family, c.language, c.bin, c.v having count(distinct o.generator) >= 2),
fp as (select fold, generator, family, bin, median(v) as v from aj group by all),
cs as (select fold, bin, median(v) as centre, stddev_samp(v) as sd from fp where fold <> generator group by all),
md as (select fold, bin, centre, sd, median(abs(v - centre)) * 1.4826 as mad from fp join cs using (fold, bin) where fold <> generator group by all),
z0 as (select fold, generator, family, bin, (v - centre) / case when mad > 1e-8 then mad when sd > 1e-8 then sd else 1.0 end as v from fp join md using (fold, bin)),
zn as (select *, v / sqrt(sum(v * v) over (partition by fold, generator)) as u from z0),
pr as (select fold, family, bin, median(u) as p from zn where fold <> generator group by all),
pn as (select fold, family, bin, p / sqrt(sum(p * p) over (partition by fold, family)) as p from pr),
scores as (select t.fold, t.family as "true", pn.family, sum(t.u * pn.p) as score from zn t join pn on t.fold = pn.fold and t.bin = pn.bin where t.fold = t.generator group by all),
preds as (select fold, "true", arg_min(family, struct_pack(s := -round(score, 12), f := family)) as predicted from scores group by all)"""


def logo(spark, sf_dir):
    return A.logo_scores(A.fold_profiles(cells(spark, sf_dir)))


@query(f'with {LOGO} select fold, "true", family, round(score, 6) as score from scores')
def logo_scores(spark, sf_dir):
    return logo(spark, sf_dir).select("fold", "true", "family", r6("score"))


@query(f'with {LOGO} select fold, "true", predicted from preds')
def logo_predictions(spark, sf_dir):
    return A.logo_predictions(logo(spark, sf_dir))


@query(f"""with {LOGO}, k as (select unnest(range(4))::int as "true") select k."true", count(predicted) filter (predicted = 0) as pred_0, count(predicted) filter (predicted = 1) as pred_1,
  count(predicted) filter (predicted = 2) as pred_2, count(predicted) filter (predicted = 3) as pred_3 from k left join preds on k."true" = preds."true" group by 1""")
def logo_confusion(spark, sf_dir):
    return I.confusion(A.logo_predictions(logo(spark, sf_dir)), "true", "predicted", [0, 1, 2, 3])


@query(f"""with {LOGO}, t as (select "true" as c, count(*) as n, count(*) filter ("true" = predicted) as hit from preds group by 1), p as (select predicted as c, count(*) as m from preds group by 1)
  select sum(n)::bigint as n, round(sum(hit)::double / sum(n), 6) as accuracy, round(avg(hit::double / n), 6) as balanced_accuracy, round(avg(2.0 * hit / (n + coalesce(m, 0))), 6) as macro_f1 from t left join p using (c)""")
def logo_metrics(spark, sf_dir):
    x = I.class_scores(A.logo_predictions(logo(spark, sf_dir)), "true", "predicted")
    return x.select("n", r6("accuracy"), r6("balanced_accuracy"), r6("macro_f1"))


@query(f"""with {PAIRS}, g as (select row_number() over (order by generator) - 1 as i, generator, family from (select distinct generator, family from prof)), n as (select count(*)::int as n from g), f as (select family, count(*) as size from g group by 1),
  subs as (select m.mask, g.generator from n, lateral (select unnest(range((1 << n.n)::bigint)) as mask) m, g where (m.mask >> g.i) & 1 = 1), sized as (select mask, count(*) as size from subs group by 1),
  d as (select t.mask, t.size, avg(cosine) filter (a.generator is not null and b.generator is not null) as inside, avg(cosine) filter ((a.generator is null) <> (b.generator is null)) as outside
    from (select * from sized where size in (select size from f)) t cross join cosines c left join subs a on a.mask = t.mask and a.generator = generator_a left join subs b on b.mask = t.mask and b.generator = generator_b group by 1, 2),
  obs as (select f.family, f.size, avg(cosine) filter (family_a = f.family and family_b = f.family) - avg(cosine) filter (family_a <> family_b and f.family in (family_a, family_b)) as observed from f, cosines group by 1, 2)
  select family, count(*) as n_subsets, round(observed, 6) as observed, round((1 + count(*) filter (inside - outside >= observed - 1e-9)) / (count(*) + 1.0), 6) as p from obs join d using (size) group by family, observed""")
def exact_subset_null(spark, sf_dir):
    """Each family against all subsets of its size, or 10,000 where they are too many: how often their contrast reaches its own."""
    from loomvec.plans import tables
    from loomvec.session import materialize

    table = materialize(similarity(spark, sf_dir), "pair-table", small=True)
    found = generator_profiles(spark, sf_dir).select("generator", "family").orderBy("generator").collect()
    items, sizes = [r["generator"] for r in found], sorted({sum(x["family"] == r["family"] for x in found) for r in found})
    plans = [tables.subsets(spark, items, size, 10_000, 1).withColumnRenamed("rep", "mask").withColumn("size", F.lit(size)) for size in sizes]
    plan = plans[0]
    for more in plans[1:]:
        plan = plan.unionByName(more)
    reps = plan.select("size", "mask").distinct()
    a = plan.select("size", "mask", F.col("item").cast("int").alias("generator_a"), F.lit(True).alias("ia"))
    b = plan.select("size", "mask", F.col("item").cast("int").alias("generator_b"), F.lit(True).alias("ib"))
    crossed = table.join(F.broadcast(reps)).join(F.broadcast(a), ["size", "mask", "generator_a"], "left").join(F.broadcast(b), ["size", "mask", "generator_b"], "left").na.fill(False, ["ia", "ib"])
    draws = crossed.groupBy("size", "mask").agg((F.avg(F.when(F.col("ia") & F.col("ib"), F.col("cosine"))) - F.avg(F.when(F.col("ia") != F.col("ib"), F.col("cosine")))).alias("d"))
    families = spark.createDataFrame([(f, sum(r["family"] == f for r in found)) for f in sorted({r["family"] for r in found})], "family int, size int")
    observed = A.within_outside(table).select("family", F.col("delta").alias("observed")).join(families, "family")
    joined = draws.join(F.broadcast(observed), "size")
    return joined.groupBy("family", "observed").agg(F.count("*").alias("n_subsets"), r6((1 + F.count_if(F.col("d") >= F.col("observed") - 1e-9)) / (F.count("*") + 1), "p")).select("family", "n_subsets", r6("observed"), "p")


@query()
def family_specific(spark, sf_dir):
    """Each family's contrast to all others: bootstrap interval, p over subsets of its size, Benjamini-Hochberg over the families."""
    from loomvec.plans import tables

    profiles = generator_profiles(spark, sf_dir)
    families = [r["family"] for r in profiles.select("generator", "family").orderBy("generator").collect()]
    draws = tables.family_draws(spark, families, 10_000, 20260711)
    return family_tests(A.family_contrast(A.similarity_table(profiles), draws)).select("family", "n", r6("within"), r6("outside"), r6("delta"), r6("low"), r6("high"), r6("p"), r6("q"), "method", "n_null", "n_boot")


def family_tests(contrasts: DataFrame) -> DataFrame:
    """One row for each family from the contrasts of its draws; families without a contrast aren't tested or counted."""
    seen = contrasts.where("kind = 'observed'").select("family", "n", "within", "outside", "delta")
    boot = contrasts.where("kind = 'boot'").groupBy("family").agg(F.percentile("delta", 0.025).alias("low"), F.percentile("delta", 0.975).alias("high"), F.count("delta").alias("n_boot"))
    null = contrasts.where("kind in ('exact', 'drawn')").select("family", F.col("kind").alias("method"), F.col("delta").alias("d")).join(F.broadcast(seen.select("family", "delta")), "family")
    above = F.count_if(F.col("d") >= F.col("delta") - 1e-15)
    p = F.when(F.col("method") == "exact", above / F.count("*")).otherwise(I.upper_p(F.col("d"), F.col("delta")))
    null = null.groupBy("family", "method", "delta").agg(p.alias("p"), F.count("*").alias("n_null")).withColumn("p", F.when(F.col("delta").isNotNull(), F.col("p"))).drop("delta")
    both = seen.join(null, "family").join(boot, "family", "left").na.fill(0, ["n_boot"]).withColumn("tested", F.col("p").isNotNull())
    return I.benjamini_hochberg(both, "p", "q", "tested").withColumn("q", F.when(F.col("tested"), F.col("q")))


@query()
def family_permutation_null(spark, sf_dir):
    """5,000 label permutations of the family contrast; the pair table is computed once."""
    from loomvec.plans import tables
    from loomvec.session import materialize

    table = materialize(similarity(spark, sf_dir), "pair-table")
    labels = {r["generator"]: r["family"] for r in generator_profiles(spark, sf_dir).select("generator", "family").orderBy("generator").collect()}
    plan = tables.label_permutations(spark, labels, 5000, 42)
    a = plan.select("rep", F.col("item").cast("int").alias("generator_a"), F.col("label").alias("family_a"))
    b = plan.select("rep", F.col("item").cast("int").alias("generator_b"), F.col("label").alias("family_b"))
    null = A.family_delta(table.drop("family_a", "family_b").join(a, "generator_a").join(b, ["rep", "generator_b"]), "rep")
    observed = A.family_delta(table).select(F.col("delta").alias("observed"))
    return null.join(F.broadcast(observed)).groupBy("observed").agg(F.count("*").alias("n_draws"), r6(I.upper_p(F.col("delta"), F.col("observed"), 0.0), "p")).select(r6("observed"), "n_draws", "p")


@query()
def family_stratified_bootstrap(spark, sf_dir):
    """2,000 draws within families; pairs of one generator with itself are left out."""
    from loomvec.plans import tables
    from loomvec.session import materialize

    table = materialize(similarity(spark, sf_dir), "pair-table")
    groups: dict = {}
    for r in generator_profiles(spark, sf_dir).select("generator", "family").orderBy("family", "generator").collect():
        groups.setdefault(r["family"], []).append(r["generator"])
    plan = tables.stratified_bootstraps(spark, groups, 2000, 43)
    a = plan.select("rep", F.col("pos").alias("pa"), F.col("item").cast("int").alias("ia"))
    b = plan.select("rep", F.col("pos").alias("pb"), F.col("item").cast("int").alias("ib"))
    drawn = a.join(b, "rep").where("pa < pb and ia <> ib").select("rep", F.least("ia", "ib").alias("generator_a"), F.greatest("ia", "ib").alias("generator_b"))
    deltas = A.family_delta(drawn.join(F.broadcast(table), ["generator_a", "generator_b"]), "rep").where("delta is not null")
    return deltas.agg(F.count("*").alias("n_draws"), r6(F.percentile("delta", 0.025), "low"), r6(F.percentile("delta", 0.975), "high"))


# -- split halves and controls -------------------------------------------------------------


def hash_blocks(spark, sf_dir, n=8):
    x = long(spark, sf_dir)
    x = x.withColumn("block", (H.seed_hex16(F.lit("BLOCK"), F.col("vec_id")) % n).cast("int"))
    return x.groupBy("generator", "block", "bin").agg(F.median("v").alias("v"))


def cell_blocks(x: DataFrame) -> DataFrame:
    """(generator, n_blocks, block, bin, v): block medians, min(50, max(4, rows / 4)) blocks for each generator by hash rank."""
    rows = x.groupBy("generator").agg(F.count("*").alias("rows"))
    n = F.when(F.col("rows") < 4, F.raise_error(F.lit("a generator has fewer rows than blocks"))).otherwise(F.least(F.lit(50), F.greatest(F.lit(4), F.floor(F.col("rows") / 4))))
    line = Window.partitionBy("generator").orderBy(H.seed_hex16(F.lit("BLOCK"), F.col("generator"), F.col("vec_id")), "vec_id")
    ranked = x.select("generator", "vec_id").withColumn("rank", F.row_number().over(line) - 1).join(F.broadcast(rows.select("generator", n.cast("int").alias("n_blocks"))), "generator")
    blocked = x.join(ranked.select("generator", "vec_id", "n_blocks", (F.col("rank") % F.col("n_blocks")).cast("int").alias("block")), ["generator", "vec_id"])
    keys = ("generator", "n_blocks", "block")
    return P.bin_medians(P.long_view(blocked, "embedding", *keys), *keys).drop("n_pairs")


BLOCKS = LONG + """,
bl as (select generator, ((('0x' || substr(sha256('BLOCK||' || vec_id::varchar), 1, 16))::ubigint)::hugeint % 4294967295 % 8)::int as block, bin, median(v) as v from long group by all)"""


@query(f"with {BLOCKS} select generator, block, bin, round(v, 6) as v from bl")
def content_block_medians(spark, sf_dir):
    return hash_blocks(spark, sf_dir).select("generator", "block", "bin", r6("v"))


@query(f"""with {BLOCKS} select a.generator, a.block, a.bin, round(median(b.v), 6) as p from bl a join bl b on a.generator = b.generator and a.bin = b.bin and a.block <> b.block
  group by a.generator, a.block, a.bin having count(*) >= 3""")
def cross_fitted_prototypes(spark, sf_dir):
    return A.block_prototypes(hash_blocks(spark, sf_dir)).select("generator", "block", "bin", r6("p"))


@query()
def split_half_contrast(spark, sf_dir):
    """200 splits of the content blocks: contrast of each, by NumPy's permutations."""
    from loomvec.plans import tables
    from loomvec.session import materialize

    blocks = materialize(cell_blocks(vectors(spark, sf_dir)), "blocks")
    sizes = sorted(r["n_blocks"] for r in blocks.select("n_blocks").distinct().collect())
    plan = tables.block_draws(spark, sizes, 200, [7], replace=False)
    return A.split_halves(blocks, plan).select("rep", r6("delta"), r6("least_same"))


@query(f"""with {LONG}, ids as (select vec_id, lead(vec_id) over (partition by language order by vec_id) as nxt, first_value(vec_id) over (partition by language order by vec_id) as fst, language from (select distinct vec_id, language from long)),
  mm as (select vec_id, coalesce(nxt, fst) as partner from ids)
  select l.generator, count(distinct l.vec_id) as n, round(avg(l.v * p.v), 6) as mean_product from long l join mm using (vec_id) join long p on p.vec_id = mm.partner and p.bin = l.bin group by 1""")
def negative_pair_control(spark, sf_dir):
    """Each recording against another one of its language."""
    x = vectors(spark, sf_dir)
    partner = M.rotated(x, "vec_id", "language").select("vec_id", "partner")
    other = x.select(F.col("vec_id").alias("partner"), F.col("embedding").alias("o"))
    double = lambda c: F.transform(c, lambda v: v.cast("double"))
    return x.join(partner, "vec_id").join(other, "partner").groupBy("generator").agg(F.count("*").alias("n"), r6(F.avg(V.dot(double("embedding"), double("o")) / 64), "mean_product"))


@query(f"""with {PROF}, h as (select vec_id, label::int as generator, vec_id % 2 as half, unnest(range(64))::int as bin, unnest(embedding)::double as v from embeddings),
  hp as (select generator, half, bin, median(v) as v from h group by all),
  m as (select a.generator as ga, b.generator as gb, corr(a.v, b.v) as rho from hp a join hp b on a.bin = b.bin where a.half = 0 and b.half = 1 group by 1, 2)
  select g.generator as tag, round(avg(rho) filter (ga = gb), 6) as same, round((sum(rho) filter (ga = g.generator and gb <> ga) + sum(rho) filter (gb = g.generator and gb <> ga)) / count(*) filter (ga <> gb), 6) as different,
  round(avg(rho) filter (ga = gb) - (sum(rho) filter (ga = g.generator and gb <> ga) + sum(rho) filter (gb = g.generator and gb <> ga)) / count(*) filter (ga <> gb), 6) as delta
  from (select distinct generator from hp) g join m on g.generator in (ga, gb) group by 1""")
def checkpoint_contrast(spark, sf_dir):
    """Same generator over two corpora (odd and even ids) less different generators, both orientations."""
    x = P.long_view(vectors(spark, sf_dir).withColumn("half", F.col("vec_id") % 2), "embedding", "generator", "half")
    r = P.arrays(P.bin_medians(x, "generator", "half"), "generator", "half").withColumnRenamed("generator", "tag")
    out = A.checkpoint_contrast(r.where("half = 0"), r.where("half = 1"), V.pearson(F.col("ra"), F.col("rb")))
    return out.select("tag", r6("same"), r6("different"), r6("delta"))


# -- multiplicity and rank tests --------------------------------------------------------------


PVALUES = "p as (select l_returnflag as grp, l_suppkey % 50 as item, avg(l_discount) as p from lineitem group by all)"


def p_values(spark, sf_dir):
    return read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("grp"), (F.col("l_suppkey") % 50).alias("item")).agg(F.avg("l_discount").alias("p"))


@query(f"""with {PVALUES}, r as (select *, (count(*) over (partition by grp) - row_number() over (partition by grp order by p, item) + 1) * p as raw from p)
  select grp, item, round(p, 6) as p, round(least(1.0, max(raw) over (partition by grp order by p, item rows unbounded preceding)), 6) as adjusted from r""")
def holm_adjust(spark, sf_dir):
    return I.holm(p_values(spark, sf_dir), "p", "adjusted", "grp").select("grp", "item", r6("p"), r6("adjusted"))


@query(f"""with {PVALUES}, r as (select *, p * count(*) over (partition by grp) / row_number() over (partition by grp order by p, item) as raw from p)
  select grp, item, round(p, 6) as p, round(least(1.0, min(raw) over (partition by grp order by p desc, item desc rows unbounded preceding)), 6) as adjusted from r""")
def bh_adjust(spark, sf_dir):
    return I.benjamini_hochberg(p_values(spark, sf_dir), "p", "adjusted", "grp").select("grp", "item", r6("p"), r6("adjusted"))


@query("""with d as (select l_returnflag as grp, l_quantity - 25.5 + l_suppkey % 3 as d from lineitem), nz as (select grp, d, abs(d) as a from d where d <> 0),
  r as (select grp, d, rank() over (partition by grp order by a) + (count(*) over (partition by grp, a) - 1) / 2.0 as rk from nz),
  t as (select grp, a, count(*) as t from nz group by all), tt as (select grp, sum(t * t * t - t) as ties from t group by all)
  select grp, count(*) as n, sum(rk) filter (d > 0) as w_plus, round((sum(rk) filter (d > 0) - count(*) * (count(*) + 1) / 4.0) / sqrt(count(*)::double * (count(*) + 1) * (2 * count(*) + 1) / 24 - any_value(ties) / 48.0), 5) as z
  from r join tt using (grp) group by grp""")
def wilcoxon_ranks(spark, sf_dir):
    d = read_table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), (F.col("l_quantity") - 25.5 + F.col("l_suppkey") % 3).alias("d"))
    return I.wilcoxon(d, "d", "grp").select("grp", "n", F.col("w_plus").cast("double").alias("w_plus"), F.round("z", 5).alias("z"))


@query("""with z as (select distinct (p_size * 3 + p_partkey % 7) / 20.0 - 4 as z from part)
  select z, round(0.5 - sum(exp(-pow(z * (k + 0.5) / 4000, 2) / 2) * z / 4000) / sqrt(2 * pi()), 6) + 0.0 as p from z, (select unnest(range(4000)) as k) group by z""")
def normal_tail(spark, sf_dir):
    """Upper tail of the standard normal over a range of values; the SQL integrates."""
    part = read_table(spark, sf_dir, "part")
    return part.select(((F.col("p_size") * 3 + F.col("p_partkey") % 7) / 20.0 - 4).alias("z")).distinct().select("z", r6(I.normal_upper(F.col("z")), "p"))


@query("""select l_returnflag as grp, round(quantile_cont(l_quantity, 0.025), 6) as low, round(quantile_cont(l_quantity, 0.975), 6) as high, round(avg(l_quantity), 6) as mean, round(median(l_quantity), 6) as med, round(stddev_samp(l_quantity), 6) as sd from lineitem group by all""")
def quantile_interval(spark, sf_dir):
    x = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("grp"))
    q = F.col("l_quantity")
    return x.agg(r6(F.percentile(q, 0.025), "low"), r6(F.percentile(q, 0.975), "high"), r6(F.avg(q), "mean"), r6(F.median(q), "med"), r6(F.stddev_samp(q), "sd"))


@query("""with e as (select l_suppkey % 60 as item, l_returnflag as grp, avg(l_discount) - 0.0499 as delta, min(l_tax) as p1, min(l_discount) * 4 as p2, max(l_tax) as p3, (l_suppkey % 60) / 1000.0 as p4, avg(l_tax) as p5 from lineitem group by all)
  select item, grp, case when delta > 0 and p3 >= 0.05 and p1 < 0.05 and p2 < 0.05 and p4 < 0.05 and p5 < 0.05 then 'SUPPORTED' else 'INSUFFICIENT_EVIDENCE' end as verdict from e""")
def h4_decision(spark, sf_dir):
    """The conjunctive rule over many tables of evidence."""
    item = F.col("l_suppkey") % 60
    e = read_table(spark, sf_dir, "lineitem").groupBy(item.alias("item"), F.col("l_returnflag").alias("grp")).agg((F.avg("l_discount") - 0.0499).alias("delta"), F.min("l_tax").alias("p1"), (F.min("l_discount") * 4).alias("p2"), F.max("l_tax").alias("p3"), F.avg("l_tax").alias("p5"))
    e = e.withColumn("p4", F.col("item") / 1000.0)
    names = ("family_similarity", "multivariate_centroid", "dispersion", "logo_balanced_accuracy", "logo_macro_f1")
    return e.select("item", "grp", I.h4_verdict(F.col("delta"), {n: F.col(f"p{k}") for k, n in enumerate(names, 1)}).alias("verdict"))


# -- hashes, labels, paths ---------------------------------------------------------------------


@query("select doc_id, substr(sha256(coalesce(source, '') || '||' || doc_id::varchar), 1, 24) as stable_id from documents")
def stable_ids(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", H.stable_id(F.coalesce("source", F.lit("")), F.col("doc_id")).alias("stable_id"))


@query("select doc_id, (('0x' || substr(sha256('H2|' || doc_id::varchar), 1, 8))::ubigint)::bigint as seed from documents")
def seed_be4(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", H.seed_be4(F.lit("H2"), F.col("doc_id")).alias("seed"))


@query("select doc_id, ((('0x' || substr(sha256('H1||' || doc_id::varchar), 1, 16))::ubigint)::hugeint % 4294967295)::bigint as seed from documents")
def seed_hex16(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", H.seed_hex16(F.lit("H1"), F.col("doc_id")).alias("seed"))


@query("""with h as (select doc_id, sha256('42::' || doc_id::varchar) as h from documents)
  select doc_id, ((('0x' || substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::ubigint)::hugeint % 1000003)::bigint as seed from h""")
def seed_le8(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", H.seed_le8(F.concat(F.lit("42::"), F.col("doc_id").cast("string")), 1_000_003).alias("seed"))


@query("select source, count(*) as n, sha256(string_agg(doc_id::varchar, chr(10) order by doc_id::varchar)) as digest from documents group by source")
def selection_digest(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), H.selection_digest(F.col("doc_id")).alias("digest"))


@query("""select page_id, split_part(url, '/', 3) as host, coalesce(nullif(split_part(url, '/', 4), ''), 'unknown') as folder, regexp_replace(replace(url, chr(92), '/'), '^[./]+', '') as cleaned,
  case when starts_with(url, 'https://') then 'web/' || substr(url, 9) when starts_with(url, 'http://') then 'plain/' || substr(url, 8) else url end as rewritten from pages""")
def path_tokens(spark, sf_dir):
    u = F.col("url")
    return read_table(spark, sf_dir, "pages").select("page_id", F.split_part(u, F.lit("/"), F.lit(3)).alias("host"), F.coalesce(F.nullif(F.split_part(u, F.lit("/"), F.lit(4)), F.lit("")), F.lit("unknown")).alias("folder"), T.clean_path(u).alias("cleaned"), T.rewrite_prefix(u, [("https://", "web/"), ("http://", "plain/")]).alias("rewritten"))


@query("""with e as (select event_id, case event_id % 8 when 0 then ' TRUE ' when 1 then 'no' when 2 then '1' when 3 then '0' when 4 then 'Yes' when 5 then 'false' when 6 then 'maybe' end as raw from events)
  select event_id, raw, case when lower(trim(raw)) in ('true', '1', 'yes') then 'true' when lower(trim(raw)) in ('false', '0', 'no') then 'false' end as parsed from e""")
def bool_parse(spark, sf_dir):
    raw = F.get(F.array(*[F.lit(x) for x in (" TRUE ", "no", "1", "0", "Yes", "false", "maybe", None)]), (F.col("event_id") % 8).cast("int"))
    return read_table(spark, sf_dir, "events").select("event_id", raw.alias("raw")).withColumn("parsed", T.parse_bool(F.col("raw")).cast("string"))


NAMES = ("HiFi-GAN v1", "Multi-Band MelGAN", "MB_MelGAN", "Full-band MelGAN", "Parallel WaveGAN", "PWG", "Style_MelGAN", "MelGAN large", "Griffin-Lim", "VITS", "Codec X", "WaveGrad diffusion", "Integrated Z", "phase rebuild", "Flow T", "Autoregressive A", "Other")
NAME_SQL = f"list_value({', '.join(repr(n) for n in NAMES)})[(p_partkey % {len(NAMES)}) + 1] || ' ' || p_size"


def _contained(column: str, rules: tuple, otherwise: str) -> str:
    return "case " + " ".join(f"when contains({column}, '{part}') then '{value}'" for part, value in rules) + f" else {otherwise} end"


@query(f"""with n as (select p_partkey, {NAME_SQL} as name from part), b as (select *, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') as bare, lower(name) as low from n)
  select p_partkey, name, {_contained('bare', T.ARCHITECTURES, 'bare')} as architecture, {_contained('low', T.FAMILIES, 'name')} as family from b""")
def label_map(spark, sf_dir):
    """Architecture and family keys of generator names."""
    name = F.concat(F.get(F.array(*[F.lit(n) for n in NAMES]), (F.col("p_partkey") % len(NAMES)).cast("int")), F.lit(" "), F.col("p_size").cast("string"))
    return read_table(spark, sf_dir, "part").select("p_partkey", name.alias("name")).select("p_partkey", "name", T.architecture_key(F.col("name")).alias("architecture"), T.family_key(F.col("name")).alias("family"))


RAW_LANGUAGES = (*T.LANGUAGES, "en_US", "EN-GB", " FRA ", "pt-BR", "sw", "zh_Hant-TW")


@query(f"""with r as (select doc_id, list_value({', '.join(repr(x) for x in RAW_LANGUAGES)})[(doc_id % {len(RAW_LANGUAGES)}) + 1] as raw from documents), l as (select *, replace(lower(trim(raw)), '_', '-') as low from r)
  select doc_id, raw, case low {' '.join(f"when '{k}' then '{v}'" for k, v in T.LANGUAGES.items())} else split_part(low, '-', 1) end as code from l""")
def language_map(spark, sf_dir):
    """Two-letter codes of language names and tags."""
    raw = F.get(F.array(*[F.lit(x) for x in RAW_LANGUAGES]), (F.col("doc_id") % len(RAW_LANGUAGES)).cast("int"))
    return read_table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw")).withColumn("code", T.language_code(F.col("raw")))


@query("""select doc_id, regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '^$', '') as cleaned, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) not in ('', 'nan', 'none', 'null', 'unknown', 'n/a', 'na', '?') as present from documents""")
def text_normalise(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", T.clean_text(F.col("text")).alias("cleaned"), T.is_present(F.col("text")).alias("present"))
