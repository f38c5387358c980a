"""Queries of the manifest layer: quality rules, guards, joins, audits, pairing, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomvec.functions import hashing as H
from loomvec.functions import text as T
from loomvec.operators import analysis as A
from loomvec.operators import manifest as M
from loomvec.queries import query, r6
from loomvec.session import read_table

MAN = """
man as (select l_orderkey, l_linenumber, l_orderkey::varchar || '-' || l_linenumber::varchar as pair_id, 'g' || (l_suppkey % 7)::varchar as generator, l_partkey as original_id, 'f' || (l_suppkey % 7 % 3)::varchar as family,
  l_returnflag as language, case when l_suppkey % 7 = 0 then 'low' when l_suppkey % 2 = 0 then 'High' else 'medium' end as confidence, l_quantity / 25.0 as fake_duration, (l_partkey % 10) / 5.0 as real_duration from lineitem)"""


def manifest(spark, sf_dir) -> DataFrame:
    g = F.col("l_suppkey") % 7
    return read_table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("pair_id"), F.concat(F.lit("g"), g).alias("generator"), F.col("l_partkey").alias("original_id"), F.concat(F.lit("f"), g % 3).alias("family"),
        F.col("l_returnflag").alias("language"), F.when(g == 0, "low").when(F.col("l_suppkey") % 2 == 0, "High").otherwise("medium").alias("confidence"), (F.col("l_quantity") / 25.0).alias("fake_duration"), ((F.col("l_partkey") % 10) / 5.0).alias("real_duration"),
    )


QC = MAN + """,
qc as (select *, concat_ws(';', case when fake_duration < 0.5 then 'fake:duration_too_short' end, case when real_duration < 0.5 then 'real:duration_too_short' end,
  case when not coalesce(real_duration > 0 and fake_duration / nullif(real_duration, 0) between 0.5 and 2, false) then 'duration_ratio_out_of_bounds' end) as exclusion_reason from man),
qs as (select *, case when exclusion_reason = '' then 'ok' else 'fail' end as qc_status from qc)"""


def checked(spark, sf_dir) -> DataFrame:
    short = lambda c: F.col(c) < 0.5
    rules = M.reasons((short("fake_duration"), "fake:duration_too_short"), (short("real_duration"), "real:duration_too_short"), (~M.ratio_ok(F.col("fake_duration"), F.col("real_duration")), "duration_ratio_out_of_bounds"))
    return manifest(spark, sf_dir).withColumn("exclusion_reason", rules).withColumn("qc_status", F.when(F.col("exclusion_reason") == "", "ok").otherwise("fail"))


@query(f"with {QC} select pair_id, exclusion_reason, qc_status from qs")
def qc_reasons(spark, sf_dir):
    return checked(spark, sf_dir).select("pair_id", "exclusion_reason", "qc_status")


@query(f"with {QC}, t as (select unnest(string_split(exclusion_reason, ';')) as reason from qs where exclusion_reason <> '') select reason, count(*) as n from t group by all")
def reason_histogram(spark, sf_dir):
    return checked(spark, sf_dir).select(F.explode(T.reason_tokens(F.col("exclusion_reason"))).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def masked(spark, sf_dir) -> DataFrame:
    ok = F.lower(F.trim("qc_status")) == "ok"
    only = T.reason_tokens(F.col("exclusion_reason")) == F.array(F.lit("duration_ratio_out_of_bounds"))
    return checked(spark, sf_dir).withColumn("in_strict", ok).withColumn("in_relaxed", ok | only)


@query(f"""with {QC} select pair_id, qc_status = 'ok' as in_strict, qc_status = 'ok' or exclusion_reason = 'duration_ratio_out_of_bounds' as in_relaxed from qs""")
def strict_relaxed_masks(spark, sf_dir):
    return masked(spark, sf_dir).select("pair_id", "in_strict", "in_relaxed")


@query(f"""with {QC}, u as (select pair_id, generator, original_id, qc_status = 'ok' as in_strict from qs where qc_status = 'ok' or exclusion_reason = 'duration_ratio_out_of_bounds')
  select pair_id, generator, original_id, in_strict, true as in_relaxed, row_number() over (order by generator, original_id, pair_id, in_strict) - 1 as union_index from u""")
def union_manifest(spark, sf_dir):
    """Rows of either population with membership flags; indexed without gaps over the whole table."""
    from loomvec.operators.checks import dense_index

    x = masked(spark, sf_dir).where("in_relaxed").select("pair_id", "generator", "original_id", "in_strict", "in_relaxed")
    return dense_index(x, "union_index", "generator", "original_id", "pair_id", "in_strict")


@query(f"with {QC}, s as (select pair_id from qs where qc_status = 'ok'), r as (select pair_id from qs where qc_status = 'ok' or exclusion_reason = 'duration_ratio_out_of_bounds') select (select count(*) from s where pair_id not in (select pair_id from r)) as n_not_in, (select count(*) from r where pair_id not in (select pair_id from s)) as n_only_relaxed")
def subset_test(spark, sf_dir):
    flags = strict_relaxed_masks(spark, sf_dir)
    s, r = flags.where("in_strict").select("pair_id"), flags.where("in_relaxed").select("pair_id")
    a = s.join(r, "pair_id", "left_anti").agg(F.count("*").alias("n_not_in"))
    return a.crossJoin(r.join(s, "pair_id", "left_anti").agg(F.count("*").alias("n_only_relaxed")))


@query(f"with {QC}, p as (select original_id, count(distinct generator) as n_generators from qs where qc_status = 'ok' group by all) select n_generators, count(*) as n_originals from p group by all")
def coverage_histogram(spark, sf_dir):
    return M.coverage(checked(spark, sf_dir).where("qc_status = 'ok'"), "original_id", "generator")


@query(f"""with {QC}, o as (select * from qs where qc_status = 'ok'), p as (select original_id from o group by all having count(distinct generator) = (select count(distinct generator) from o))
  select pair_id, generator, original_id from o where original_id in (select original_id from p)""")
def balanced_population(spark, sf_dir):
    """Pairs of the originals that every generator has."""
    return M.balanced(checked(spark, sf_dir).where("qc_status = 'ok'"), "original_id", "generator").select("pair_id", "generator", "original_id")


@query(f"""with {QC}, c as (select generator, count(*) as n_candidates, count(*) filter (qc_status = 'ok') as n_ok, count(*) filter (exclusion_reason = 'duration_ratio_out_of_bounds') as n_ratio_only, count(distinct language) as n_languages from qs group by all)
  select *, max(n_ok) over () = min(n_ok) over () as balanced from c""")
def inventory(spark, sf_dir):
    x = checked(spark, sf_dir).groupBy("generator").agg(F.count("*").alias("n_candidates"), F.count_if(F.col("qc_status") == "ok").alias("n_ok"), F.count_if(F.col("exclusion_reason") == "duration_ratio_out_of_bounds").alias("n_ratio_only"), F.count_distinct("language").alias("n_languages"))
    edge = x.agg((F.max("n_ok") == F.min("n_ok")).alias("balanced"))
    return x.crossJoin(F.broadcast(edge))


@query(f"""with {QC}, g as (select family, generator, confidence, count(*) as n_pairs, count(distinct language) as n_languages, string_agg(distinct language, '|' order by language) as languages from qs where qc_status = 'ok' group by all)
  select *, n_pairs >= 30 and lower(confidence) in ('high', 'medium') as eligible from g""")
def generator_eligibility(spark, sf_dir):
    return M.eligibility(checked(spark, sf_dir).where("qc_status = 'ok'"))[0]


@query(f"""with {QC}, g as (select family, generator, confidence, count(*) as n_pairs from qs where qc_status = 'ok' group by all)
  select family, count(distinct generator) as n_generators, sum(n_pairs)::bigint as n_pairs, count(distinct generator) >= 3 as eligible from g where n_pairs >= 30 and lower(confidence) in ('high', 'medium') group by family""")
def family_eligibility(spark, sf_dir):
    return M.eligibility(checked(spark, sf_dir).where("qc_status = 'ok'"))[1]


@query(f"with {QC}, c as (select generator, language, count(*) as n_valid_pairs from qs where qc_status = 'ok' group by all) select *, n_valid_pairs >= 30 as meets_min_pairs from c")
def cell_eligibility(spark, sf_dir):
    x = checked(spark, sf_dir).where("qc_status = 'ok'").groupBy("generator", "language").agg(F.count("*").alias("n_valid_pairs"))
    return x.withColumn("meets_min_pairs", F.col("n_valid_pairs") >= 30)


@query(f"with {QC} select language, count(*) filter (qc_status = 'ok') as ok, count(*) filter (qc_status = 'fail') as fail, round(avg((qc_status = 'ok')::int), 6) as ok_share from qs group by all")
def status_crosstab(spark, sf_dir):
    x = checked(spark, sf_dir).groupBy("language")
    s = F.col("qc_status")
    return x.agg(F.count_if(s == "ok").alias("ok"), F.count_if(s == "fail").alias("fail"), r6(F.avg((s == "ok").cast("double")), "ok_share"))


@query(f"with {QC} select count(*) as n_contradictions from qs where qc_status = 'ok' and trim(exclusion_reason) <> ''")
def contradiction_guard(spark, sf_dir):
    return checked(spark, sf_dir).where((F.col("qc_status") == "ok") & (F.trim("exclusion_reason") != "")).agg(F.count("*").alias("n_contradictions"))


@query(f"with {MAN} select generator, original_id, count(*) as n_rows from man group by all having count(*) > 1")
def uniqueness_guard(spark, sf_dir):
    return M.repeated_keys(manifest(spark, sf_dir), "generator", "original_id")


@query(f"with {MAN} select generator, count(distinct confidence) as n_values from man group by all having count(distinct confidence) > 1")
def dependency_guard(spark, sf_dir):
    return M.ambiguous(manifest(spark, sf_dir), "generator", "confidence")


@query(f"with {MAN} select count(*) as n_rows, count(distinct generator) as n_generators, count(distinct family) as n_families, count(distinct language) as n_languages, count(distinct original_id) as n_originals from man")
def population_counts(spark, sf_dir):
    names = {"generator": "n_generators", "family": "n_families", "language": "n_languages", "original_id": "n_originals"}
    return manifest(spark, sf_dir).agg(F.count("*").alias("n_rows"), *[F.count_distinct(c).alias(n) for c, n in names.items()])


@query("""select p_partkey, p_name, s_name, n_name, r_name, s_suppkey is null as unmatched from part left join supplier on p_partkey % 200 = s_suppkey left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey""")
def taxonomy_join(spark, sf_dir):
    """Many-to-one left joins; dimension sides are broadcast by the planner where they are small."""
    part, supplier, nation, region = (read_table(spark, sf_dir, t) for t in ("part", "supplier", "nation", "region"))
    x = part.join(supplier, part["p_partkey"] % 200 == supplier["s_suppkey"], "left").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return x.select("p_partkey", "p_name", "s_name", "n_name", "r_name", F.col("s_suppkey").isNull().alias("unmatched"))


@query("""with e as (select distinct p_partkey as k from part), a as (select distinct l_partkey + 7 as k from lineitem)
  select coalesce(e.k, a.k) as k, case when a.k is null then 'missing' else 'extra' end as what from e full join a on e.k = a.k where e.k is null or a.k is null""")
def expected_versus_actual(spark, sf_dir):
    e = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).distinct()
    a = read_table(spark, sf_dir, "lineitem").select((F.col("l_partkey") + 7).alias("k")).distinct()
    both = e.withColumn("e", F.lit(True)).join(a.withColumn("a", F.lit(True)), "k", "full")
    return both.where("e is null or a is null").select("k", F.when(F.col("a").isNull(), "missing").otherwise("extra").alias("what"))


@query("""with a as (select doc_id, lang, source from documents where doc_id % 3 > 0), b as (select doc_id, case when doc_id % 50 = 0 then 'xx' else lang end as lang, source from documents where doc_id % 3 < 2)
  select a.doc_id, a.lang as lang_a, b.lang as lang_b from a join b using (doc_id) where a.lang is distinct from b.lang or a.source is distinct from b.source""")
def overlap_consistency(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    a = d.where("doc_id % 3 > 0").select("doc_id", F.col("lang").alias("lang_a"), F.col("source").alias("sa"))
    b = d.where("doc_id % 3 < 2").select("doc_id", F.when(F.col("doc_id") % 50 == 0, "xx").otherwise(F.col("lang")).alias("lang_b"), F.col("source").alias("sb"))
    return a.join(b, "doc_id").where(~(F.col("lang_a").eqNullSafe(F.col("lang_b")) & F.col("sa").eqNullSafe(F.col("sb")))).select("doc_id", "lang_a", "lang_b")


AUD = """
hm as (select doc_id, source as generator, doc_id // 3 as original_id, sha256(text) as fake_sha256, case when doc_id % 50 = 7 then sha256(text) else sha256(lang || (doc_id % 400)::varchar) end as real_sha256,
  case when coalesce(l.quality, 1) = 1 then 'ok' else 'fail' end as qc_status, case when coalesce(l.quality, 1) = 1 then '' else 'low_quality' end as exclusion_reason from documents left join (select doc_id, min(quality) as quality from labels group by 1) l using (doc_id)),
h1 as (select fake_sha256 as sha256, count(*) as n_rows, count(distinct original_id) as n_original_ids, count(distinct generator) as n_generators from hm where qc_status = 'ok' and fake_sha256 is not null group by 1),
b1 as (select * from h1 where n_original_ids > 1 or n_generators > 1),
m1 as (select hm.*, b1.sha256 is not null and qc_status = 'ok' as hit from hm left join b1 on fake_sha256 = b1.sha256),
t1 as (select doc_id, generator, original_id, fake_sha256, real_sha256, case when hit then 'fail' else qc_status end as qc_status, case when hit then 'ambiguous_fake_hash_duplicate' else exclusion_reason end as exclusion_reason from m1),
h2 as (select real_sha256 as sha256, count(*) as n_rows, count(distinct original_id) as n_original_ids, count(distinct generator) as n_generators from t1 where qc_status = 'ok' and real_sha256 is not null group by 1),
b2 as (select * from h2 where n_original_ids > 1),
m2 as (select t1.*, b2.sha256 is not null and qc_status = 'ok' as hit from t1 left join b2 on real_sha256 = b2.sha256),
t2 as (select doc_id, generator, original_id, fake_sha256, real_sha256, case when hit then 'fail' else qc_status end as qc_status, case when hit then 'ambiguous_real_hash_duplicate' else exclusion_reason end as exclusion_reason from m2),
b3 as (select fake_sha256 as sha256 from t2 where qc_status = 'ok' and fake_sha256 is not null intersect select real_sha256 from t2 where qc_status = 'ok'),
t3 as (select doc_id, case when qc_status = 'ok' and fake_sha256 in (select sha256 from b3) then 'fail' else qc_status end as qc_status,
  case when qc_status = 'ok' and fake_sha256 in (select sha256 from b3) then 'fake_real_hash_collision' else exclusion_reason end as exclusion_reason from t2)"""


def hashed(spark, sf_dir) -> DataFrame:
    quality = read_table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    good = F.coalesce("quality", F.lit(1)) == 1
    d = read_table(spark, sf_dir, "documents").join(quality, "doc_id", "left")
    return d.select(
        "doc_id", F.col("source").alias("generator"), F.floor(F.col("doc_id") / 3).cast("long").alias("original_id"), F.sha2(F.col("text").cast("binary"), 256).alias("fake_sha256"),
        F.sha2(F.when(F.col("doc_id") % 50 == 7, F.col("text")).otherwise(F.concat("lang", (F.col("doc_id") % 400).cast("string"))).cast("binary"), 256).alias("real_sha256"), F.when(good, "ok").otherwise("fail").alias("qc_status"), F.when(good, "").otherwise("low_quality").alias("exclusion_reason"),
    )


@query(f"with {AUD} select sha256, n_rows, n_original_ids, n_generators from b1")
def hash_audit_fake(spark, sf_dir):
    x = hashed(spark, sf_dir).where("qc_status = 'ok'")
    return M.hash_groups(x, "fake_sha256", "original_id", "generator").where("n_original_ids > 1 or n_generators > 1")


@query(f"with {AUD} select sha256, n_rows, n_original_ids, n_generators from (select real_sha256 as sha256, count(*) as n_rows, count(distinct original_id) as n_original_ids, count(distinct generator) as n_generators from hm where qc_status = 'ok' group by 1) where n_original_ids > 1")
def hash_audit_real(spark, sf_dir):
    return M.hash_groups(hashed(spark, sf_dir).where("qc_status = 'ok'"), "real_sha256", "original_id", "generator").where("n_original_ids > 1")


@query("select count(*) as n_collisions from (select sha256(text) as h from documents intersect select sha256(text) from benchmark)")
def hash_audit_cross(spark, sf_dir):
    of = lambda t: read_table(spark, sf_dir, t).select(F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return of("documents").intersect(of("benchmark")).agg(F.count("*").alias("n_collisions"))


@query(f"with {AUD} select doc_id, qc_status, exclusion_reason from t3")
def hash_audit_sequential(spark, sf_dir):
    return M.hash_audit(hashed(spark, sf_dir))[0].select("doc_id", "qc_status", "exclusion_reason")


@query(f"with {AUD} select 'ambiguous_fake_hash' as audit_type, sha256, n_rows from b1 union all select 'ambiguous_real_hash', sha256, n_rows from b2 union all select 'fake_real_hash_collision', fake_sha256, count(*) from t2 where fake_sha256 in (select sha256 from b3) group by all")
def hash_audit_rows(spark, sf_dir):
    return M.hash_audit(hashed(spark, sf_dir))[1]


@query("""with o as (select distinct o_custkey as speaker, o_orderkey as original from orders), w as (select *, lead(original) over (partition by speaker order by original) as nxt, min(original) over (partition by speaker) as fst, count(*) over (partition by speaker) as n from o),
  g as (select original, coalesce(lead(original) over (order by original), min(original) over ()) as wrap from o)
  select original, speaker, case when n = 1 then wrap else coalesce(nxt, fst) end as partner from w join g using (original)""")
def mismatch_rotation(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("speaker"), F.col("o_orderkey").alias("original"))
    return M.mismatch(o, "original", "speaker")


@query("""with o as (select distinct o_orderpriority as lang, o_custkey as item from orders), n as (select *, row_number() over (partition by lang order by item) - 1 as i, count(*) over (partition by lang) as n from o),
  s as (select *, 1 + ((('0x' || substr(sha256('mismatch_lang||' || lang), 1, 16))::ubigint)::hugeint % 4294967295)::bigint % (n - 1) as shift from n where n > 1)
  select a.lang, a.item, b.item as partner from s a join s b on a.lang = b.lang and b.i = (a.i + a.shift) % a.n""")
def hashed_rotation(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("lang"), F.col("o_custkey").alias("item"))
    return M.hashed_rotation(o, "item", "mismatch_lang", "lang")


@query("""with h as (select source, doc_id, sha256('BLOCK|' || doc_id::varchar) as h from documents) select source, doc_id, ((row_number() over (partition by source order by h, doc_id) - 1) % 5)::int as block from h""")
def content_blocks_rank(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("source", "doc_id")
    token = F.sha2(F.concat(F.lit("BLOCK|"), F.col("doc_id").cast("string")).cast("binary"), 256)
    return M.blocks_by_rank(d, "doc_id", token, 5, "source").select("source", "doc_id", "block")


@query("select doc_id, (((('0x' || substr(sha256('FALSE-PAIR-BLOCK||' || doc_id::varchar), 1, 16))::ubigint)::hugeint % 4294967295) % 10)::int as block from documents")
def content_blocks_hash(spark, sf_dir):
    return M.blocks_by_hash(read_table(spark, sf_dir, "documents"), "doc_id", "FALSE-PAIR-BLOCK", 10)


@query("""select conv_id, role, turn, text from (select *, row_number() over (partition by conv_id, role order by turn desc, text desc) as k from conversations) where k = 1""")
def last_wins_dedup(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", "text")
    return M.last_wins(c, ["turn", "text"], "conv_id", "role").select("conv_id", "role", "turn", "text")


@query("""with f as (select distinct regexp_replace(regexp_extract(url, '^[a-z]+://(.*)$', 1), '^[./]+', '') as path from pages), w as (select path from f where hash(path) = hash(path)
    union select split_part(path, '/', 1) || substr(path, length(split_part(path, '/', 1)) + length(split_part(path, '/', 2)) + 2) from f where length(path) - length(replace(path, '/', '')) >= 2),
  i as (select split_part(path, '/', 1) || substr(path, length(split_part(path, '/', 1)) + length(split_part(path, '/', 2)) + 2) as path, count(*) as n, min(path) as long from f where length(path) - length(replace(path, '/', '')) >= 2 group by 1)
  select w.path, case when f.path is null and n = 1 then long else w.path end as resolved, case when f.path is not null then 'direct' when n = 1 then 'inserted_second_level_unique' when n > 1 then 'ambiguous_multiple_matches' else 'not_found' end as method
  from w left join f on w.path = f.path left join i on w.path = i.path""")
def path_resolution(spark, sf_dir):
    """Paths asked for with and without their second folder, resolved against the listing."""
    f = read_table(spark, sf_dir, "pages").select(T.clean_path(F.regexp_extract("url", "^[a-z]+://(.*)$", 1)).alias("path")).distinct()
    parts = F.split("path", "/", -1)
    short = f.where(F.size(parts) > 2).select(F.concat_ws("/", F.get(parts, F.lit(0)), F.array_join(F.slice(parts, 3, F.size(parts)), "/")).alias("path"))
    return M.resolve_paths(f.union(short), f)


SIG = """
sg as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) - 1 as i, count(*) over (partition by user_id) as n from events),
fr as (select user_id, k::int as frame, k * 2 as start from (select user_id, max(n) as n from sg group by 1), lateral (select unnest(range(((greatest(n, 4) - 4) // 2 + 1)::bigint)) as k)),
rm as (select f.user_id, f.frame, sqrt(coalesce(sum(value * value), 0) / 4.0) as rms from fr f left join sg s on f.user_id = s.user_id and s.i >= f.start and s.i < f.start + 4 group by all),
db as (select *, 20 * log10(rms + 1e-12) as db from rm),
ct as (select user_id, greatest(quantile_cont(db, 0.95) - 40, -80) as cut from db group by all),
ld as (select *, db >= cut as loud from db join ct using (user_id)),
rk as (select *, row_number() over (partition by user_id order by rms desc, frame desc) as k, count(*) filter (loud) over (partition by user_id) as n_loud from ld)"""


@query(f"with {SIG} select user_id, frame, round(db, 4) as db, case when n_loud >= 3 then loud else k <= 3 end as active from rk")
def frame_rms_vad(spark, sf_dir):
    """Frames of four, hop two, of each user's values in time order; level and activity."""
    e = read_table(spark, sf_dir, "events")
    s = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("e")).select("user_id", F.col("e.value").alias("s"))
    return A.active_frames(A.framed(s, "s", 4, 2, "user_id"), "user_id").select("user_id", "frame", F.round("db", 4).alias("db"), "active")


@query("select json_extract_string(props, '$.k') as k, count(*) as n, round(avg(value), 6) as mean from events group by 1")
def json_field(spark, sf_dir):
    return read_table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"), r6(F.avg("value"), "mean"))


@query("select count(*) as n_rows, (select count(*) from information_schema.columns where table_name = 'documents') as n_columns from documents")
def footer_counts(spark, sf_dir):
    """Row count and schema without reading data columns."""
    d = read_table(spark, sf_dir, "documents")
    return d.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(d.columns)))


@query("""select n_name, coalesce(n, 0) as n, coalesce(n, 0) > 5 as meets, case when coalesce(n, 0) > 5 then 'ok' else 'too_few' end as verdict from nation left join (select s_nationkey, count(*) as n from supplier group by 1) on n_nationkey = s_nationkey""")
def registry_check(spark, sf_dir):
    """Every expected key gets a verdict; a missing value can't pass."""
    got = read_table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    x = read_table(spark, sf_dir, "nation").join(got, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_name", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return x.withColumn("meets", F.col("n") > 5).withColumn("verdict", F.when(F.col("meets"), "ok").otherwise("too_few"))


@query("select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def event_windows(spark, sf_dir):
    """Tumbling windows by the streaming operator, run over the table as one batch."""
    from loomvec.streaming.windows import tumbling

    x = tumbling(read_table(spark, sf_dir, "events"), "ts", "1 hour", "value", "event_type")
    return x.select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


@query("select o_orderkey, (('0x' || substr(sha256(o_orderkey::varchar), 1, 8))::ubigint)::bigint as draw, o_custkey from (select *, row_number() over (partition by o_custkey order by (('0x' || substr(sha256(o_orderkey::varchar), 1, 8))::ubigint), o_orderkey) as k from orders) where k <= 3")
def stratified_cap(spark, sf_dir):
    """Up to three items of each speaker, by a hash order."""
    from pyspark.sql.window import Window

    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").withColumn("draw", H.seed_be4(F.col("o_orderkey")))
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("draw", "o_orderkey"))
    return o.withColumn("k", k).where("k <= 3").select("o_orderkey", "draw", "o_custkey")
