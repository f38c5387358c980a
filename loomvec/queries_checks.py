"""Queries of guards, manifest assembly, checkpoint contrasts and pairing controls."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomvec.functions import vectors as V
from loomvec.operators import analysis as A
from loomvec.operators import checks as C
from loomvec.operators import inference as I
from loomvec.operators import manifest as M
from loomvec.operators import profiles as P
from loomvec.plans import tables
from loomvec.queries import CELLS, HZ, LONG, cells, query, r6, vectors
from loomvec.queries_manifest import AUD, MAN, QC, checked, hashed, manifest
from loomvec.session import materialize, read_table

# -- rules and guards --------------------------------------------------------------


@query(f"with {MAN} select pair_id, printf('self_vocoding_duration_mismatch:%.3fs', abs(fake_duration - real_duration)) as reason from man where abs(fake_duration - real_duration) > 0.25")
def self_vocoding_gap(spark, sf_dir):
    x = manifest(spark, sf_dir).select("pair_id", C.self_vocoding_reason(F.col("fake_duration"), F.col("real_duration")).alias("reason"))
    return x.where("reason is not null")


SOURCED = QC + """,
sr as (select *, case when l_orderkey % 11 = 0 then ' ' else 'f/' || pair_id end as fake_path, case when l_orderkey % 13 = 0 then null else 'r/' || original_id end as real_path,
  case when l_orderkey % 17 = 0 then '' else sha256(pair_id) end as fake_sha256, sha256(original_id::varchar) as real_sha256 from qs)"""


@query(f"""with {SOURCED} select pair_id, qc_status = 'ok' or (exclusion_reason = 'duration_ratio_out_of_bounds' and trim(coalesce(fake_path, '')) <> '' and trim(coalesce(real_path, '')) <> ''
  and trim(coalesce(fake_sha256, '')) <> '' and trim(coalesce(real_sha256, '')) <> '') as in_relaxed from sr""")
def relaxed_with_sources(spark, sf_dir):
    """The relaxed population: nothing but the duration failed, and both files and hashes are known."""
    order = F.split_part("pair_id", F.lit("-"), F.lit(1)).cast("long")
    sha = lambda c: F.sha2(F.col(c).cast("string").cast("binary"), 256)
    fake, real = F.when(order % 11 == 0, " ").otherwise(F.concat(F.lit("f/"), "pair_id")), F.when(order % 13 != 0, F.concat(F.lit("r/"), F.col("original_id").cast("string")))
    mask = C.relaxed(F.col("qc_status"), F.col("exclusion_reason"), fake, real, F.when(order % 17 == 0, "").otherwise(sha("pair_id")), sha("original_id"))
    return checked(spark, sf_dir).select("pair_id", mask.alias("in_relaxed"))


@query(f"with {QC} select count(*) as n, count(*) filter (qc_status = 'ok') as n_ok, round(avg((qc_status = 'ok')::int), 6) as share from qs")
def success_rate(spark, sf_dir):
    return C.success_rate(checked(spark, sf_dir), "qc_status").select("n", "n_ok", r6("share"))


@query("select path from (select distinct url as path from pages where url is not null) order by (('0x' || substr(sha256(path || '|7'), 1, 8))::ubigint), path limit 80")
def path_sample(spark, sf_dir):
    """Eighty paths whose existence a run looks up."""
    return C.path_sample(read_table(spark, sf_dir, "pages"), "url", 80, 7)


MEASURED = """
measured as (select 'f' || p_partkey as path, sha256(p_name) as sha256, p_size / 10.0 as duration, case when p_size % 7 = 0 then 'fail' else 'ok' end as qc_status, case when p_size % 7 = 0 then 'clipping;silence' else '' end as exclusion_reason from part where p_partkey % 50 > 0
  union all select 'r' || s_suppkey, sha256(s_name), 2.5, case when s_suppkey % 9 = 0 then 'fail' else 'ok' end, case when s_suppkey % 9 = 0 then 'too_long' else '' end from supplier),
cand as (select l_orderkey || '-' || l_linenumber as pair_id, 'f' || l_partkey as fake_path, 'r' || l_suppkey as real_path from lineitem),
made as (select c.*, f.sha256 as fake_sha256, r.sha256 as real_sha256, f.qc_status as fs, r.qc_status as rs,
  concat_ws(';', case when f.path is null then 'fake:missing' when f.exclusion_reason <> '' then 'fake:clipping;fake:silence' end, case when r.path is null then 'real:missing' when r.exclusion_reason <> '' then 'real:too_long' end,
    case when f.duration is not null and r.duration is not null and not (r.duration > 0 and f.duration / r.duration between 0.5 and 2) then 'duration_ratio_out_of_bounds' end) as exclusion_reason
  from cand c left join measured f on c.fake_path = f.path left join measured r on c.real_path = r.path)"""


def measured_files(spark, sf_dir):
    """(fakes, reals): their paths differ in the first letter."""
    part, supplier = read_table(spark, sf_dir, "part").where("p_partkey % 50 > 0"), read_table(spark, sf_dir, "supplier")
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    bad, long = F.col("p_size") % 7 == 0, F.col("s_suppkey") % 9 == 0
    fake = part.select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("path"), sha("p_name").alias("sha256"), (F.col("p_size") / 10).alias("duration"), F.when(bad, "fail").otherwise("ok").alias("qc_status"), F.when(bad, "clipping;silence").otherwise("").alias("exclusion_reason"))
    real = supplier.select(F.concat(F.lit("r"), F.col("s_suppkey").cast("string")).alias("path"), sha("s_name").alias("sha256"), F.lit(2.5).alias("duration"), F.when(long, "fail").otherwise("ok").alias("qc_status"), F.when(long, "too_long").otherwise("").alias("exclusion_reason"))
    return fake, real


@query(f"with {MEASURED} select pair_id, fake_sha256, real_sha256, exclusion_reason, case when exclusion_reason = '' then 'ok' else 'fail' end as qc_status from made")
def manifest_assembly(spark, sf_dir):
    """One manifest row for every candidate pair, failures included; each file is measured once."""
    l = read_table(spark, sf_dir, "lineitem")  # noqa: E741
    candidates = l.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("pair_id"), F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("fake_path"), F.concat(F.lit("r"), F.col("l_suppkey").cast("string")).alias("real_path"))
    fakes, reals = measured_files(spark, sf_dir)
    return C.manifest_rows(candidates, fakes, real_measured=reals).select("pair_id", "fake_sha256", "real_sha256", "exclusion_reason", "qc_status")


@query("select vec_id, vec_id % 5 > 0 as ok from embeddings")
def numeric_differences(spark, sf_dir):
    """Vectors against stored ones, within tolerance; every fifth is moved."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    moved = e.select("vec_id", F.transform("embedding", lambda x: x.cast("double") + F.when(F.col("vec_id") % 5 == 0, 1e-2).otherwise(1e-6)).alias("embedding"))
    return C.numeric_differences(e, moved, "vec_id", "embedding").select("vec_id", "ok")


@query("""select n_name as key, round(e.v, 6) as expected, round(f.v, 6) as found, case when f.v is null then 'missing' when abs(f.v - e.v) <= 500 then 'ok' else 'off' end as verdict
  from nation left join (select c_nationkey as k, avg(c_acctbal) as v from customer group by 1) e on e.k = n_nationkey left join (select s_nationkey as k, avg(s_acctbal) as v from supplier where s_suppkey % 3 > 0 group by 1) f on f.k = n_nationkey where e.v is not null""")
def tolerance_check(spark, sf_dir):
    """Recomputed values against a registry, each with its tolerance; a missing one never passes."""
    nation = read_table(spark, sf_dir, "nation")
    mean = lambda t, k, v: t.join(nation, t[k] == nation["n_nationkey"]).groupBy(F.col("n_name").alias("key")).agg(F.avg(v).alias("value"))
    expected = mean(read_table(spark, sf_dir, "customer"), "c_nationkey", "c_acctbal").withColumn("tolerance", F.lit(500.0))
    found = mean(read_table(spark, sf_dir, "supplier").where("s_suppkey % 3 > 0"), "s_nationkey", "s_acctbal")
    return C.within_tolerance(found, expected, "key", "value").select("key", r6("expected"), r6("found"), "verdict")


@query(f"""with {AUD}, f as (select fake_sha256 as sha256, count(*) as n from hm where fake_sha256 is not null group by 1 having count(distinct original_id) > 1 or count(distinct generator) > 1), r as (select real_sha256 as sha256, count(*) as n from hm where real_sha256 is not null group by 1 having count(distinct original_id) > 1)
  select 'fake' as kind, sha256, n as n_rows from f union all select 'real', sha256, n from r union all select 'fake_is_real', fake_sha256, count(*) from hm where fake_sha256 in (select real_sha256 from hm) group by all""")
def hash_collisions(spark, sf_dir):
    """All three kinds of colliding hashes; ``hash_guard`` raises on any."""
    return C.collisions(materialize(hashed(spark, sf_dir), "hashed"))


# -- joins, order, limits ----------------------------------------------------------


@query("select o_orderkey, case when o_custkey % 7 = 0 then 'unknown' else coalesce(nullif(trim(c_mktsegment), ''), 'unknown') end as speaker_id from orders left join customer on o_custkey = c_custkey")
def speaker_default(spark, sf_dir):
    """The speaker by a one-to-one join, 'unknown' where the manifest names none."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("pair_id"))
    known = read_table(spark, sf_dir, "customer").where("c_custkey % 7 > 0").select(F.col("c_custkey").alias("pair_id"), F.col("c_mktsegment").alias("speaker_id"))
    return C.speaker_of(orders, known, "pair_id").select("o_orderkey", "speaker_id")


@query("select s_name, n_name, n_regionkey, s_suppkey from supplier left join nation on s_nationkey = n_nationkey")
def taxonomy_rejoin(spark, sf_dir):
    """Old taxonomy columns are dropped and joined again, in a fixed order."""
    nation = read_table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "key")
    old = read_table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "key").withColumn("n_name", F.lit("old"))
    return C.rejoined(old, nation, "key", "n_name", "n_regionkey", front=("s_name", "n_name", "n_regionkey")).select("s_name", "n_name", "n_regionkey", "s_suppkey")


@query("select o_orderkey, row_number() over (order by o_custkey, o_orderkey) - 1 as source_index from orders")
def dense_index(spark, sf_dir):
    """A gapless index over the whole table, numbered by ranges."""
    return C.dense_index(read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "source_index", "o_custkey", "o_orderkey").select("o_orderkey", "source_index")


@query("select o_orderkey, o_totalprice, o_custkey from orders order by o_totalprice desc, o_orderkey limit 10")
def preview_rows(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey").withColumn("down", -F.col("o_totalprice"))
    return C.preview(o, 10, "down", "o_orderkey").drop("down")


OVERLAP = ("partkey", "suppkey", "quantity", "price", "discount", "tax", "flag", "status")


@query("""with a as (select l_orderkey || '-' || l_linenumber as pair_id, l_partkey as partkey, l_suppkey as suppkey, l_quantity as quantity, l_extendedprice as price, l_discount as discount, l_tax as tax, l_returnflag as flag, l_linestatus as status from lineitem),
  b as (select pair_id, partkey + (partkey % 40 = 0)::int as partkey, case when suppkey % 30 = 0 then null else suppkey end as suppkey, quantity, price, discount, tax, case when flag = 'R' and partkey % 3 = 0 then 'X' else flag end as flag, status from a where partkey % 4 > 0)
  select pair_id, columns from (select a.pair_id, concat_ws('|', """ + ", ".join(f"case when a.{c} is distinct from b.{c} then '{c}' end" for c in OVERLAP) + """) as columns from a join b using (pair_id)) where columns <> ''""")
def overlap_columns(spark, sf_dir):
    """Which of eight columns two populations disagree about, for the pairs that both hold."""
    l = read_table(spark, sf_dir, "lineitem")  # noqa: E741
    names = ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    a = l.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("pair_id"), *[F.col(n).alias(o) for n, o in zip(names, OVERLAP, strict=True)])
    b = a.where("partkey % 4 > 0").withColumn("flag", F.when((F.col("flag") == "R") & (F.col("partkey") % 3 == 0), "X").otherwise(F.col("flag"))).withColumn("suppkey", F.when(F.col("suppkey") % 30 != 0, F.col("suppkey"))).withColumn("partkey", F.col("partkey") + (F.col("partkey") % 40 == 0).cast("int"))
    return C.inconsistent(a, b, "pair_id", *OVERLAP)


# -- references and tests ------------------------------------------------------------


FEW = CELLS + """,
few as (select * from cells where language < 3 or generator in (1, 2)),
loc as (select c.generator, c.language, c.bin, median(o.v) as ref, count(distinct o.generator) as n_reference from few c left join few o on c.language = o.language and c.bin = o.bin and c.generator <> o.generator group by all),
glo as (select g.generator, o.bin, median(o.v) as ref from (select distinct generator from few) g join few o on o.generator <> g.generator group by all)"""


@query(f"with {FEW} select generator, language, bin, round(case when n_reference >= 2 then loc.ref else glo.ref end, 6) as ref, n_reference from loc join glo using (generator, bin)")
def reference_fallback(spark, sf_dir):
    """References where languages without two other generators take the median over all of them."""
    few = materialize(cells(spark, sf_dir).where("language < 3 or generator in (1, 2)"), "few-cells", small=True)
    return P.language_reference(few, short="global").select("generator", "language", "bin", r6("ref"), "n_reference")


@query("""with d as (select s_nationkey as grp, s_acctbal - 4500 as d from supplier where s_acctbal <> 4500), r as (select grp, d, row_number() over (partition by grp order by abs(d)) as rk from d),
  w as (select grp, count(*)::int as n, sum(rk) filter (d > 0) as w from r group by 1), draws as (select grp, mask, n, coalesce(w, 0) as w from w, lateral (select unnest(range((1 << n)::bigint)) as mask)),
  s as (select grp, mask, n, w, list_sum(list_transform(range(n), lambda i: case when (mask >> i) & 1 = 1 then i + 1 else 0 end)) as s from draws)
  select grp, n::bigint as n, w::double as w_plus, round(count(*) filter (s >= w) / count(*), 9) as p, 'exact' as method from s group by grp, n, w""")
def wilcoxon_exact(spark, sf_dir):
    """Signed-rank test of suppliers' balances by nation: few values, so the whole null is counted."""
    d = read_table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("grp"), (F.col("s_acctbal") - 4500).alias("d"))
    return I.wilcoxon_p(I.wilcoxon(d, "d", "grp")).select("grp", "n", F.coalesce("w_plus", F.lit(0.0)).cast("double").alias("w_plus"), F.round("p", 9).alias("p"), "method")


@query("""with e as (select l_returnflag as grp, l_suppkey % 40 as item, avg(l_discount) - 0.05 as m1, avg(l_tax) - 0.04 as m2, min(l_discount) as p1, avg(l_discount) as p2 from lineitem group by all)
  select grp, item, case when m1 > 0 and m1 - 0.0005 > 0 and p1 <= 0.05 and m2 > 0 and m2 - 0.0005 > 0 and p2 <= 0.05 then 'SUPPORTED' when m1 > 0 and m1 - 0.0005 > 0 and p1 <= 0.05 then 'SHAPE_SUPPORTED_FREQUENCY_INSUFFICIENT' else 'INSUFFICIENT_EVIDENCE' end as both,
  case when m1 - 0.0005 > 0 then 'SUPPORTED' else 'INSUFFICIENT_EVIDENCE' end as single from e""")
def co_primary_decision(spark, sf_dir):
    """Decision rules of one endpoint and of two co-primary ones, over many tables of evidence."""
    e = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("grp"), (F.col("l_suppkey") % 40).alias("item")).agg((F.avg("l_discount") - 0.05).alias("m1"), (F.avg("l_tax") - 0.04).alias("m2"), F.min("l_discount").alias("p1"), F.avg("l_discount").alias("p2"))
    end = lambda k: {"mean": F.col(f"m{k}"), "low": F.col(f"m{k}") - 0.0005, "p": F.col(f"p{k}")}
    return e.select("grp", "item", I.co_primary_verdict(end(1), end(2)).alias("both"), I.h1_verdict(F.col("m1") - 0.0005).alias("single"))


# -- checkpoints (H3a) ---------------------------------------------------------------


HALVES = """
h as (select label::int as g, vec_id % 2 as half, unnest(range(64))::int as bin, unnest(embedding)::double as v from embeddings),
hp as (select g, half, bin, median(v) as v from h group by all),
rk as (select *, rank() over (partition by g, half order by v) + (count(*) over (partition by g, half, v) - 1) / 2.0 as rk, abs(v) / sum(abs(v)) over (partition by g, half) as w from hp),
cu as (select *, sum(w) over (partition by g, half order by bin) as c from rk),
qt as (select g, half, quantile_cont(abs(v), 0.9) as q90, quantile_cont(abs(v), 0.95) as q95, quantile_cont(abs(v), 0.85) as q85 from hp group by all),
pf as (select cu.*, abs(v) >= q90 as t90, abs(v) >= q95 as t95, abs(v) >= q85 as t85 from cu join qt using (g, half)),
pm as (select a.g as ga, b.g as gb, corr(a.v, b.v) as pearson, sum(a.v * b.v) / sqrt(sum(a.v * a.v) * sum(b.v * b.v)) as cosine, corr(a.rk, b.rk) as spearman, sqrt(avg((a.v - b.v) * (a.v - b.v))) as rmse, avg(abs(a.v - b.v)) as mae,
  count(*) filter (a.t90 and b.t90) / count(*) filter (a.t90 or b.t90) as jaccard_top10, count(*) filter (a.t90 and b.t90 and sign(a.v) = sign(b.v)) / count(*) filter (a.t90 or b.t90) as signed_jaccard_top10,
  count(*) filter (a.t95 and b.t95) / count(*) filter (a.t95 or b.t95) as jaccard_top5, count(*) filter (a.t85 and b.t85) / count(*) filter (a.t85 or b.t85) as jaccard_top15, sum(abs(a.c - b.c)) filter (a.bin < 63) * 125.0 as wasserstein_hz
  from pf a join pf b on a.bin = b.bin where a.half = 0 and b.half = 1 group by 1, 2),
up as (unpivot pm on pearson, cosine, spearman, rmse, mae, jaccard_top10, signed_jaccard_top10, jaccard_top5, jaccard_top15, wasserstein_hz into name metric value m),
cm as (select t.g as tag, metric, avg(m) filter (ga = gb) as same, avg(m) filter (ga <> gb) as different from (select distinct g from hp) t join up on t.g = ga or t.g = gb group by all),
cd as (select *, case when metric in ('rmse', 'mae', 'wasserstein_hz') then different - same else same - different end as delta from cm)"""


def halves(spark, sf_dir):
    x = P.long_view(vectors(spark, sf_dir).withColumn("half", F.col("vec_id") % 2), "embedding", "generator", "half")
    r = materialize(P.arrays(P.bin_medians(x, "generator", "half"), "generator", "half").withColumnRenamed("generator", "tag"), "halves", small=True)
    return r.where("half = 0"), r.where("half = 1")


def checkpoint_deltas(spark, sf_dir):
    hz = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i * F.lit(HZ))
    return A.checkpoint_metrics(*halves(spark, sf_dir), hz)


@query(f"with {HALVES} select tag, metric, round(same, 5) as same, round(different, 5) as different, round(delta, 5) as delta from cd")
def checkpoint_metrics(spark, sf_dir):
    """All ten metrics of each checkpoint over two corpora, against other checkpoints in both orientations."""
    return checkpoint_deltas(spark, sf_dir).select("tag", "metric", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("same", "different", "delta")])


@query(f"""with {HALVES} select metric, count(*) as n, round(avg(delta), 5) as mean_delta, round(median(delta), 5) as median_delta, count(*) filter (delta > 0) as positive, count(*) filter (delta = 0) as zero, count(*) filter (delta < 0) as negative, pow(2.0, -count(*)) as least_p from cd group by metric""")
def checkpoint_group(spark, sf_dir):
    x = A.group_effects(checkpoint_deltas(spark, sf_dir), "metric")
    return x.select("metric", "n", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("mean_delta", "median_delta")], "positive", "zero", "negative", "least_p")


@query()
def checkpoint_decision(spark, sf_dir):
    """Both endpoints over the checkpoints: mean, bootstrap interval, exact sign flips, and the verdict."""
    deltas = materialize(checkpoint_deltas(spark, sf_dir).where("metric in ('pearson', 'jaccard_top10')"), "deltas", small=True)
    items = sorted(r["tag"] for r in deltas.select("tag").distinct().collect())
    plan = tables.bootstraps(spark, items, 10_000, tables.seed_of("group_boot", 20260711))
    draws = deltas.join(F.broadcast(plan), deltas["tag"] == plan["item"]).groupBy("metric", "rep").agg(F.avg("delta").alias("mean"))
    ends = draws.groupBy("metric").agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))
    tests = [I.signflip_p(deltas.where(F.col("metric") == m), "delta").withColumn("metric", F.lit(m)) for m in ("pearson", "jaccard_top10")]
    rows = tests[0].unionByName(tests[1]).join(ends, "metric")
    wide = rows.agg(*[F.max(F.when(F.col("metric") == m, F.struct("mean", "low", "high", "p"))).alias(k) for k, m in (("shape", "pearson"), ("support", "jaccard_top10"))])
    verdict = I.co_primary_verdict({k: F.col(f"shape.{k}") for k in ("mean", "low", "p")}, {k: F.col(f"support.{k}") for k in ("mean", "low", "p")})
    return wide.select(*[r6(F.col(f"{e}.{k}"), f"{e}_{k}") for e in ("shape", "support") for k in ("mean", "low", "high", "p")], verdict.alias("verdict"))


@query()
def content_bootstrap(spark, sf_dir):
    """Per checkpoint: 1,000 redraws of its recordings in each corpus, intervals of Pearson and of the top tenth's Jaccard."""
    rows = vectors(spark, sf_dir).select(F.col("generator").alias("tag"), (F.col("vec_id") % 2).cast("int").alias("side"), F.col("vec_id").alias("item"), "embedding")
    drawn = A.redrawn_rows(rows, 1000, 20260711)
    a, b = (drawn.where(f"side = {k}").select("tag", "rep", F.col("r").alias(f"r{k}")) for k in (0, 1))
    both = a.join(b, ["tag", "rep"]).select("tag", V.pearson(F.col("r0"), F.col("r1")).alias("pearson"), V.jaccard(V.threshold_bins(F.col("r0"), 0.9), V.threshold_bins(F.col("r1"), 0.9)).alias("jaccard"))
    ends = lambda c: [r6(F.percentile(c, q), f"{c}_{n}") for q, n in ((0.025, "low"), (0.975, "high"))]
    return both.groupBy("tag").agg(F.count("*").alias("n"), *ends("pearson"), *ends("jaccard"))


# -- wrong originals (negative pairs) ----------------------------------------------------


NEGATIVE = LONG + """,
ps as (select vec_id as pair_id, vec_id // 2 as original, generator, language, bin, v, (vec_id % 5) / 10.0 as off from long),
sp as (select vec_id // 2 as original, bin, v * 0.5 as s from long where vec_id % 2 = 0),
ol as (select distinct original, case when original % 3 = 0 then 'unknown' else 's' || original % 5 end as speaker, 'l' || original % 2 as lang from ps where original in (select original from sp)),
n1 as (select *, row_number() over (partition by lang, speaker order by original) - 1 as i, count(*) over (partition by lang, speaker) as n from ol),
m1 as (select a.original, b.original as partner from (select *, 1 + ((('0x' || substr(sha256('mismatch||' || lang || '||' || speaker), 1, 16))::ubigint)::hugeint % 4294967295)::bigint % (n - 1) as shift from n1 where n > 1) a join n1 b on a.lang = b.lang and a.speaker = b.speaker and b.i = (a.i + a.shift) % a.n),
n2 as (select *, row_number() over (partition by lang order by original) - 1 as i, count(*) over (partition by lang) as n from ol),
m2 as (select a.original, b.original as partner from (select *, 1 + ((('0x' || substr(sha256('mismatch_lang||' || lang), 1, 16))::ubigint)::hugeint % 4294967295)::bigint % (n - 1) as shift from n2 where n > 1) a join n2 b on a.lang = b.lang and b.i = (a.i + a.shift) % a.n),
pt as (select ol.original, coalesce(m1.partner, m2.partner) as partner, case when m1.partner is not null then 'same_language_same_speaker' else 'same_language' end as rule from ol left join m1 using (original) left join m2 using (original)),
fo as (select ps.*, ((('0x' || substr(sha256('proto||' || original::varchar || '||701'), 1, 16))::ubigint)::hugeint % 4294967295 % 10)::int as fold from ps where original in (select original from ol)),
pr as (select a.generator, a.language, k.fold, a.bin, median(a.v) as p from fo a join (select unnest(range(10))::int as fold) k on a.fold <> k.fold group by all),
rw as (select f.pair_id, f.original, f.generator, f.language, f.fold, f.bin, f.v, f.v + f.off + o.s - w.s as raw, t.partner from fo f join pt t using (original) join sp o on o.original = f.original and o.bin = f.bin join sp w on w.original = t.partner and w.bin = f.bin),
ce as (select rw.*, raw - median(raw) filter (bin between 1 and 60) over (partition by pair_id) as wrong from rw),
np as (select pair_id, any_value(original) as original, any_value(partner) as partner, sqrt(avg(v * v)) as paired_rms, sqrt(avg(wrong * wrong)) as mismatched_rms, corr(v, p) as paired_corr, corr(wrong, p) as mismatched_corr from ce join pr using (generator, language, fold, bin) group by pair_id),
ng as (select original, count(*) as n_pairs, avg(mismatched_rms - paired_rms) as delta_rms, avg(paired_corr - mismatched_corr) as delta_corr from np group by original)"""


def originals(spark, sf_dir):
    """(pairs, spectra, partners) over the vectors: two neighbouring ids share an original, whose spectrum is the even one's."""
    x = vectors(spark, sf_dir).select(F.col("vec_id").alias("pair_id"), F.floor(F.col("vec_id") / 2).cast("long").alias("original"), "generator", "language", ((F.col("vec_id") % 5) / 10).alias("offset"), F.transform("embedding", lambda v: v.cast("double")).alias("r"))
    spectra = x.where("pair_id % 2 = 0").select("original", F.transform("r", lambda v: v * 0.5).alias("s"))
    known = x.join(spectra.select("original"), "original", "left_semi")
    who = known.select("original", F.concat(F.lit("l"), (F.col("original") % 2).cast("string")).alias("lang"), F.when(F.col("original") % 3 != 0, F.concat(F.lit("s"), (F.col("original") % 5).cast("string"))).alias("speaker"))
    return known, spectra, materialize(M.same_language_partner(who, "original", "lang", "speaker"), "partners", small=True)


def negative_effects(spark, sf_dir):
    pairs, spectra, partners = originals(spark, sf_dir)
    found = A.negative_pairs(pairs, spectra, partners.select("original", "partner"), 1, 60, 10, 701)
    return found.groupBy("original").agg(F.count("*").alias("n_pairs"), F.avg(F.col("mismatched_rms") - F.col("paired_rms")).alias("delta_rms"), F.avg(F.col("paired_corr") - F.col("mismatched_corr")).alias("delta_corr"))


@query(f"with {NEGATIVE} select original, partner, rule from pt")
def negative_partners(spark, sf_dir):
    """The wrong original of each: same language, same speaker where possible, by a hashed shift."""
    return originals(spark, sf_dir)[2]


@query(f"with {NEGATIVE} select original, n_pairs, round(delta_rms, 5) as delta_rms, round(delta_corr, 5) as delta_corr from ng")
def negative_pair_effects(spark, sf_dir):
    """Per original: how much the wrong original changes the residual's size and its likeness to the cross-fitted prototype."""
    return negative_effects(spark, sf_dir).select("original", "n_pairs", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("delta_rms", "delta_corr")])


@query(f"""with {NEGATIVE}, d as (select 'rms' as k, delta_rms as d from ng where delta_rms <> 0 union all select 'corr', delta_corr from ng where delta_corr <> 0), r as (select k, d, rank() over (partition by k order by abs(d)) as rk from d)
  select k, count(*) as n, sum(rk) filter (d > 0)::double as w_plus from r group by k""")
def negative_pair_ranks(spark, sf_dir):
    """Signed ranks of the original-level differences (p-values and Holm by ``wilcoxon_p`` and ``holm``)."""
    x = negative_effects(spark, sf_dir)
    d = x.select(F.lit("rms").alias("k"), F.col("delta_rms").alias("d")).unionByName(x.select(F.lit("corr").alias("k"), F.col("delta_corr").alias("d")))
    return I.wilcoxon(d, "d", "k").select("k", "n", F.col("w_plus").cast("double").alias("w_plus"))


@query()
def negative_pair_test(spark, sf_dir):
    """Both differences: signed-rank p, Holm over the two."""
    x = materialize(negative_effects(spark, sf_dir), "negative-effects", small=True)
    d = x.select(F.lit("rms").alias("k"), F.col("delta_rms").alias("d")).unionByName(x.select(F.lit("corr").alias("k"), F.col("delta_corr").alias("d")))
    p = I.wilcoxon_p(I.wilcoxon(d, "d", "k")).join(d.groupBy("k").agg(F.avg("d").alias("mean_delta")), "k")
    return I.holm(p.select("k", "n", "mean_delta", "p", "method"), "p", "p_holm").select("k", "n", r6("mean_delta"), F.round("p", 9).alias("p"), F.round("p_holm", 9).alias("p_holm"), "method")
