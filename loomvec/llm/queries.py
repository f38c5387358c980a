"""The subpackage's queries, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomvec.llm import langid, linededup, media, mixing, ngram_join, packing, spotsigs, substrings, toxicity, urlfilter
from loomvec.session import read_table

#: The rules that the query judges by: (verdict, host + path).
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of any document that an earlier place holds too."""
    return substrings.repeated_spans(read_table(spark, sf_dir, "documents"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored in an ISO container, read back and summarised."""
    return media.text_media(read_table(spark, sf_dir, "documents"))


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness."""
    return spotsigs.compare_edited(read_table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and component under Jaccard of at least 0.8."""
    return ngram_join.jaccard_components(read_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from the documents that aren't held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every whole text, learned from the labels that aren't held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    found = toxicity.toxicity(docs, model)
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the rules, else by the list.

    The tables bring no block list, so the list here is the canonical URLs of
    ``pages`` whose MD5 starts with the digit 0, about one in sixteen.
    """
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    canonical = urlfilter.canonical_url(*urlfilter.url_parts(F.col("url")))
    listed = pages.select(canonical.alias("canonical")).where(F.substring(F.md5(F.col("canonical").cast("binary")), 1, 1) == "0")
    return urlfilter.url_filter(pages, listed, URL_RULES)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that repeat an earlier one, equal or within one edit."""
    return linededup.dedup_lines(read_table(spark, sf_dir, "documents")).select("doc_id", "text", "lines_dropped")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the sources' target weights."""
    return mixing.mix(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_media_columns": op3_media_columns,
    "op4_spotsigs": op4_spotsigs,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_language_id": op6_language_id,
    "op7_toxicity": op7_toxicity,
    "op8_url_filter": op8_url_filter,
    "op9_line_dedup": op9_line_dedup,
    "op10_mixing": op10_mixing,
}

OP8_SQL = r"""
with parts as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), cut as (
  select page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path,
         ltrim(regexp_replace(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '(^|&)(utm_[a-z]+|ref)=[^&]*', '', 'g'), '&') as query
  from parts
), named as (
  select page_id, host, path,
         regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
         || case when query <> '' then '?' || query else '' end as canonical
  from cut
), listed as (select distinct canonical from named where canonical <> '' and substr(md5(canonical), 1, 1) = '0'),
rules(verdict, rule, rhost, rpath) as (values
  ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'), ('allow', 'net/de/', 'net', '/de/'),
  ('block', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/')),
fits as (
  select n.page_id, n.host, n.path, arg_max(r.rule, length(r.rule)) as rule, arg_max(r.verdict, length(r.rule)) as verdict
  from (select distinct page_id, host, path from named) n join rules r
    on (n.host = r.rhost or ends_with(n.host, '.' || r.rhost)) and starts_with(n.path, r.rpath)
  group by 1, 2, 3)
select n.page_id, n.host, n.path, f.rule, coalesce(f.verdict, case when l.canonical is not null then 'block' else 'allow' end) as verdict,
       l.canonical is not null as listed
from named n left join listed l on n.canonical = l.canonical left join fits f on n.page_id = f.page_id and n.host = f.host and n.path = f.path
"""

ORACLE_SQL: dict[str, str] = {"op8_url_filter": OP8_SQL}
