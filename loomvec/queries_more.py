"""Queries of the controls, cross-dataset comparison, seeded nulls and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomvec.functions import vectors as V
from loomvec.operators import analysis as A
from loomvec.operators import inference as I
from loomvec.operators import manifest as M
from loomvec.operators import profiles as P
from loomvec.plans import tables
from loomvec.queries import BLOCKS, SCALED, cell_blocks, cells, hash_blocks, long, query, r6, scaled_long, similarity, vectors
from loomvec.session import materialize, read_table

FALSE = BLOCKS + """,
bo as (select vec_id, generator, language, ((('0x' || substr(sha256('BLOCK||' || vec_id::varchar), 1, 16))::ubigint)::hugeint % 4294967295 % 8)::int as block, bin, v from long),
pr as (select a.generator, a.block, a.bin, median(b.v) as p from bl a join bl b on a.generator = b.generator and a.bin = b.bin and a.block <> b.block group by all having count(*) >= 3),
ids as (select distinct vec_id, language from long),
mm as (select vec_id, coalesce(lead(vec_id) over (partition by language order by vec_id), min(vec_id) over (partition by language)) as partner from ids),
tr as (select vec_id, any_value(bo.generator) as generator, corr(v, p) as r_true from bo join pr using (generator, block, bin) group by vec_id),
fa as (select m.vec_id, corr(x.v, p) as r_false from mm m join (select distinct vec_id, generator, block from bo) o using (vec_id) join pr using (generator, block) join long x on x.vec_id = m.partner and x.bin = pr.bin group by m.vec_id),
fp as (select vec_id, generator, r_true, r_false from tr join fa using (vec_id))"""


def false_pairs(spark, sf_dir):
    """Each vector against its generator's prototype from other blocks, and its rotated partner against the same."""
    from loomvec.functions.hashing import seed_hex16

    x = vectors(spark, sf_dir).withColumn("block", (seed_hex16(F.lit("BLOCK"), F.col("vec_id")) % 8).cast("int"))
    double = F.transform("embedding", lambda v: v.cast("double"))
    own = x.select("vec_id", "generator", "language", "block", double.alias("own"))
    proto = P.arrays(A.block_prototypes(hash_blocks(spark, sf_dir)).withColumnRenamed("p", "v"), "generator", "block")
    partner = M.rotated(x, "vec_id", "language").select("vec_id", "partner")
    other = own.select(F.col("vec_id").alias("partner"), F.col("own").alias("other"))
    joined = own.join(proto, ["generator", "block"]).join(partner, "vec_id").join(other, "partner")
    return joined.select("vec_id", "generator", V.pearson(F.col("own"), F.col("r")).alias("r_true"), V.pearson(F.col("other"), F.col("r")).alias("r_false"))


@query(f"with {FALSE} select vec_id, generator, round(r_true, 6) as r_true, round(r_false, 6) as r_false from fp")
def false_pair_metrics(spark, sf_dir):
    return false_pairs(spark, sf_dir).select("vec_id", "generator", r6("r_true"), r6("r_false"))


@query(f"with {FALSE} select generator, count(*) as n, round(avg(r_true), 6) as true_mean, round(avg(r_false), 6) as false_mean, round(avg(r_true - r_false), 6) as delta, count(*) filter (r_true > r_false) as n_greater from fp group by generator")
def false_pair_control(spark, sf_dir):
    x = false_pairs(spark, sf_dir)
    d = F.col("r_true") - F.col("r_false")
    return x.groupBy("generator").agg(F.count("*").alias("n"), r6(F.avg("r_true"), "true_mean"), r6(F.avg("r_false"), "false_mean"), r6(F.avg(d), "delta"), F.count_if(d > 0).alias("n_greater"))


@query(f"""with {FALSE}, d as (select r_true - r_false as d, abs(r_true - r_false) as a from fp where r_true <> r_false), r as (select d, a, rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 as rk from d)
  select count(*) as n, round((sum(rk) filter (d > 0) - count(*) * (count(*) + 1) / 4.0) / sqrt(count(*)::double * (count(*) + 1) * (2 * count(*) + 1) / 24), 4) as z from r""")
def false_pair_wilcoxon(spark, sf_dir):
    d = false_pairs(spark, sf_dir).select(F.lit(1).alias("k"), (F.col("r_true") - F.col("r_false")).alias("d"))
    return I.wilcoxon(d, "d", "k").select("n", F.round("z", 4).alias("z"))


H3B = """
hl as (select vec_id % 2 as ctx, label::int as generator, (label % 5)::int as arch, (label % 2)::int as family, unnest(range(64))::int as bin, unnest(embedding)::double as v from embeddings),
hp as (select ctx, generator, arch, family, bin, median(v) as v from hl group by all),
ha as (select ctx, arch, any_value(family) as family, bin, median(v) as v from hp group by ctx, arch, bin)"""


def context_profiles(spark, sf_dir):
    """(ctx, generator, arch, family, r): even and odd ids as two datasets."""
    x = vectors(spark, sf_dir).select((F.col("vec_id") % 2).alias("ctx"), "generator", (F.col("generator") % 5).alias("arch"), (F.col("generator") % 2).alias("family"), "embedding")
    keys = ("ctx", "generator", "arch", "family")
    return P.arrays(P.bin_medians(P.long_view(x, "embedding", *keys), *keys), *keys)


@query(f"with {H3B} select a.arch, round(corr(a.v, b.v), 6) as rho from ha a join ha b on a.arch = b.arch and a.bin = b.bin where a.ctx = 0 and b.ctx = 1 group by a.arch")
def h3b_observed(spark, sf_dir):
    long = context_profiles(spark, sf_dir).select("ctx", "arch", F.posexplode("r").alias("bin", "v"))
    r = P.arrays(long.groupBy("ctx", "arch", "bin").agg(F.median("v").alias("v")), "ctx", "arch")
    a, b = r.where("ctx = 0").select("arch", F.col("r").alias("ra")), r.where("ctx = 1").select("arch", F.col("r").alias("rb"))
    return a.join(b, "arch").select("arch", r6(V.pearson(F.col("ra"), F.col("rb")), "rho"))


@query()
def h3b_table(spark, sf_dir):
    """Observed likeness, its null from 10,000 random groups of the same family and sizes, Holm over the comparisons."""
    profiles = materialize(context_profiles(spark, sf_dir), "context-profiles", small=True)
    groups = {}
    for r in profiles.select("ctx", "generator", "arch", "family").orderBy("ctx", "generator").collect():
        groups.setdefault((r["ctx"], r["family"]), []).append(r["generator"])
        groups.setdefault((r["ctx"], r["family"], r["arch"]), []).append(r["generator"])
    comparisons = [(arch, fam, groups[0, fam, arch], groups[0, fam], groups[1, fam, arch], groups[1, fam]) for ctx, fam, arch in sorted(k for k in groups if len(k) == 3 and k[0] == 0) if (1, fam, arch) in groups]
    plan = tables.paired_subsets(spark, comparisons, 10_000, 20260711)
    return h3b_tests(A.subset_likeness(profiles, plan)).select("test", "fam", "n_draws", r6("observed"), r6("p"), r6("p_holm"))


def h3b_tests(likeness):
    """Observed likeness, upper p over the draws and Holm over all comparisons."""
    seen = likeness.where("real").select("test", "fam", F.col("rho").alias("observed"))
    counted = likeness.join(F.broadcast(seen), ["test", "fam"]).groupBy("test", "fam", "observed")
    above = F.sum(F.when(F.col("rho") >= F.col("observed") - 1e-15, F.col("n")).otherwise(0))
    p = counted.agg(F.sum("n").alias("n_draws"), ((above + 1) / (F.sum("n") + 1)).alias("p"))
    return I.holm(p, "p", "p_holm")


@query()
def block_bootstrap(spark, sf_dir):
    """Fingerprints of redrawn blocks (500 redraws of three seeds) against the full one: likeness and distance by generator."""
    blocks = materialize(cell_blocks(vectors(spark, sf_dir)), "blocks")
    sizes = sorted(r["n_blocks"] for r in blocks.select("n_blocks").distinct().collect())
    x = A.redrawn_blocks(blocks, tables.block_draws(spark, sizes, 500, [20260711, 20260729, 20260817], replace=True))
    return x.groupBy("generator").agg(F.count("*").alias("n"), r6(F.avg("rho"), "rho"), r6(F.percentile("rho", 0.025), "rho_low"), r6(F.avg("rmse"), "rmse"))


@query()
def centroid_permutation_null(spark, sf_dir):
    """5,000 label permutations of pseudo-F, R2 and the dispersion F, with their upper p."""
    r = materialize(P.arrays(scaled_long(spark, sf_dir), "generator", "family"), "scaled", small=True)
    labels = {x["generator"]: x["family"] for x in r.select("generator", "family").orderBy("generator").collect()}
    plan = tables.label_permutations(spark, labels, 5000, 42).unionByName(r.select(F.lit(-1).cast("long").alias("rep"), F.col("generator").cast("long").alias("item"), F.col("family").cast("long").alias("label")))
    a, b = (r.select(F.col("generator").cast("long").alias(x), F.col("r").alias(f"r{x}")) for x in "ab")
    distances = a.join(b).select("a", "b", F.pow(V.euclidean(F.col("ra"), F.col("rb")), 2).alias("d2"))
    return centroid_tests(A.centroid_draws(distances, plan)).select(r6("observed"), "n_draws", r6("p"), r6("r2"), r6("p_r2"), r6("dispersion_f"), r6("p_dispersion"))


def centroid_tests(draws):
    """One row of observed values (rep -1) and upper p-values; the same grouping drawn again counts as equal."""
    seen = draws.where("rep < 0").select(F.col("pseudo_f").alias("observed"), F.col("r2").alias("seen_r2"), F.col("dispersion_f").alias("seen_d"))
    p = lambda c, o: I.upper_p(F.col(c), F.col(o), 1e-9)
    out = draws.where("rep >= 0").join(F.broadcast(seen)).groupBy("observed", "seen_r2", "seen_d")
    out = out.agg(F.count("*").alias("n_draws"), p("pseudo_f", "observed").alias("p"), p("r2", "seen_r2").alias("p_r2"), p("dispersion_f", "seen_d").alias("p_dispersion"))
    return out.withColumnsRenamed({"seen_r2": "r2", "seen_d": "dispersion_f"})


@query()
def logo_permutation_null(spark, sf_dir):
    """1,000 label permutations of the leave-one-out balanced accuracy and macro F1; folds and adjustment stay as they are."""
    folds = A.fold_profiles(cells(spark, sf_dir))
    z = P.scaled(folds, P.robust_scale(folds.where("not held").select("fold", "bin", "v"), "fold"), "fold")
    arrays = materialize(P.arrays(z, "fold", "generator", "family", "held").withColumn("z", V.l2_normalised(F.col("r"))).select("fold", "generator", "family", "held", "z"), "fold-scores", small=True)
    labels = {r["generator"]: r["family"] for r in arrays.select("generator", "family").distinct().orderBy("generator").collect()}
    plan = tables.label_permutations(spark, labels, 1000, 44).select("rep", F.col("item").cast("int").alias("generator"), F.col("label").cast("int").alias("family"))
    plan = plan.unionByName(arrays.select(F.lit(-1).cast("long").alias("rep"), "generator", "family").distinct())
    scores = I.class_scores_by(A.logo_draws(arrays.drop("family"), plan), "true", "predicted", len(set(labels.values())), "rep")
    return logo_tests(scores).select(r6("observed"), "n_draws", r6("p"), r6("macro_f1"), r6("p_macro_f1"))


def logo_tests(scores):
    """One row of observed scores (rep -1) and upper p-values."""
    seen = scores.where("rep < 0").select(F.col("ba").alias("observed"), F.col("f1").alias("macro_f1"))
    out = scores.where("rep >= 0").join(F.broadcast(seen)).groupBy("observed", "macro_f1")
    return out.agg(F.count("*").alias("n_draws"), I.upper_p(F.col("ba"), F.col("observed"), 1e-12).alias("p"), I.upper_p(F.col("f1"), F.col("macro_f1"), 1e-12).alias("p_macro_f1"))


@query(f"with {SCALED}, d as (select a.generator as ga, b.generator as gb, any_value(a.family) as fa, any_value(b.family) as fb, sum((a.v - b.v) * (a.v - b.v)) as d2 from z a join z b on a.bin = b.bin group by 1, 2), k as (select fa as family, count(distinct ga) as n from d group by 1) select round(sum(d2 / (2.0 * n)), 6) as ssw, count(*) as n_pairs from d join k on fa = k.family and fb = k.family")
def within_sum_by_pairs(spark, sf_dir):
    """The within-family sum of squares from pair distances alone, as permutations use it."""
    r = P.arrays(scaled_long(spark, sf_dir), "generator", "family")
    a, b = r.select("family", F.col("generator").alias("ga"), F.col("r").alias("ra")), r.select("family", F.col("generator").alias("gb"), F.col("r").alias("rb"))
    n = r.groupBy("family").agg(F.count("*").alias("n"))
    d = a.join(b, "family").join(F.broadcast(n), "family").select(F.pow(V.euclidean(F.col("ra"), F.col("rb")), 2).alias("d2"), "n")
    return d.agg(r6(F.sum(F.col("d2") / (2 * F.col("n"))), "ssw"), F.count("*").alias("n_pairs"))


@query(f"with {BLOCKS}, h as (select generator, block % 2 as half, bin, median(v) as v from bl group by all) select a.generator as ga, b.generator as gb, round(corr(a.v, b.v), 6) as rho from h a join h b on a.bin = b.bin where a.half = 0 and b.half = 1 group by 1, 2")
def half_cross_matrix(spark, sf_dir):
    """Every generator's first half of blocks against every one's second half."""
    h = hash_blocks(spark, sf_dir).withColumn("half", F.col("block") % 2).groupBy("generator", "half", "bin").agg(F.median("v").alias("v"))
    r = P.arrays(h, "generator", "half")
    a, b = r.where("half = 0").select(F.col("generator").alias("ga"), F.col("r").alias("ra")), r.where("half = 1").select(F.col("generator").alias("gb"), F.col("r").alias("rb"))
    return a.join(b).select("ga", "gb", r6(V.pearson(F.col("ra"), F.col("rb")), "rho"))


@query("""with l as (select vec_id, (vec_id % 4)::int as language, unnest(range(64))::int as bin, unnest(embedding)::double as v from embeddings) select language, bin, round(median(v), 6) as v, count(*) as n from l group by all""")
def global_language_median(spark, sf_dir):
    """Median over all recordings of a language: the reference that is not cross-fitted."""
    return long(spark, sf_dir).groupBy("language", "bin").agg(r6(F.median("v"), "v"), F.count("*").alias("n"))


@query(f"""with {SCALED}, pq as (select generator, family, bin, median(v) as v from cells group by all),
  pa as (select a.generator as ga, b.generator as gb, any_value(a.family) as fa, any_value(b.family) as fb, sum(a.v * b.v) / sqrt(sum(a.v * a.v) * sum(b.v * b.v)) as cosine from pq a join pq b on a.bin = b.bin and a.generator < b.generator group by 1, 2),
  si as (select avg(cosine) filter (fa = fb) as w, avg(cosine) filter (fa <> fb) as b from pa),
  fm as (select family, bin, avg(v) as fm, count(*) as size from z group by all), gm as (select bin, avg(v) as gm from z group by all),
  sst as (select sum((v - gm) * (v - gm)) as sst, count(distinct generator) as n from z join gm using (bin)), ssb as (select sum(size * (fm - gm) * (fm - gm)) as ssb, count(distinct family) as k from fm join gm using (bin)),
  c as (select family, bin, avg(v) as c from z group by all), d as (select generator, family, sqrt(sum((v - c) * (v - c))) as d from z join c using (family, bin) group by all),
  g as (select avg(d) as gmn, count(*) as n from d), f as (select family, avg(d) as m, count(*) as n from d group by all),
  df as (select (select sum(f.n * (m - gmn) * (m - gmn)) / (count(*) - 1) from f, g) / ((select sum((d - m) * (d - m)) from d join f using (family)) / ((select n from g) - (select count(*) from f))) as df)
  select json_object('similarity', json_object('within', round(w, 6), 'between', round(b, 6), 'delta', round(w - b, 6)), 'centroid', json_object('pseudo_f', round((ssb / (k - 1)) / greatest((sst - ssb) / (n - k), 1e-15), 6), 'r2', round(ssb / sst, 6)),
    'dispersion', json_object('dispersion_f', round(df, 6), 'n', (select n from g), 'k', (select count(*) from f)))::varchar as report from si, sst, ssb, df""")
def summary_report(spark, sf_dir):
    """The analysis' numbers as one JSON document."""
    table = similarity(spark, sf_dir)
    parts = A.family_delta(table).select(F.struct(r6("within"), r6("between"), r6("delta")).alias("similarity"))
    z = scaled_long(spark, sf_dir)
    parts = parts.crossJoin(A.centroid_f(z).select(F.struct(r6("pseudo_f"), r6("r2")).alias("centroid"))).crossJoin(A.dispersion_f(z).select(F.struct(r6("dispersion_f"), "n", "k").alias("dispersion")))
    return parts.select(F.to_json(F.struct("*")).alias("report"))


@query("select source as generator, count(*) as n_files, count(distinct sha256(text)) as n_distinct, sum(length(text))::bigint as n_chars, min(doc_id) as first_id, max(doc_id) as last_id from documents group by source")
def file_inventory(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.groupBy(F.col("source").alias("generator")).agg(F.count("*").alias("n_files"), F.count_distinct(F.sha2(F.col("text").cast("binary"), 256)).alias("n_distinct"), F.sum(F.char_length("text")).alias("n_chars"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
