"""URL filter: host rules, and a blocked Bloom filter before an exact join.

The listed canonical URLs fill a blocked Bloom filter: one 512-bit block for
each URL, one bit in each of its eight 64-bit lanes. Pages whose bits are all
set are possible hits; an exact join on the canonical URL removes the false
positives. The filter's size follows from the list's length; it is broadcast
only while it stays under ``BROADCAST_BYTES``, and joined by block number
beyond that. Pages are read once: those that can't be hits go through the
exact join under keys that fit nothing and are dealt out evenly. Everything
is DataFrame expressions.

Defined cases: a null url, or one without ``://``, has empty host and path and
is allowed unless a rule fits (none can); repeated rows are judged each; an
empty list or table gives no hits; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomvec.session import materialize

LANES = 8
BITS_PER_URL = 16
BLOCK_BYTES = 72
BROADCAST_BYTES = 32 << 20
#: Keys over which rows are dealt that a join must not match.
APART = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, query) as plain text operations, never null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    return host, path, query


def canonical_url(host: Column, path: Column, query: Column) -> Column:
    """Without scheme, ``www.``, default port, closing slash, fragment and tracking parameters."""
    name = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    kept = F.ltrim(F.regexp_replace(query, r"(^|&)(utm_[a-z]+|ref)=[^&]*", ""), F.lit("&"))
    return F.concat(name, F.regexp_replace(path, r"/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def first_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls.

    A rule is (verdict, host + path); it fits its host and all subdomains if
    the path starts with the rule's. Rules of one length that could fit the
    same url are taken in their text's order. The list is a parameter of
    bounded length.
    """
    if len(rules) > 1000:
        raise ValueError("more than 1000 rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        name, slash, tail = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + tail)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _bits(key: Column) -> list[Column]:
    hashed = F.xxhash64(key)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(hashed, 6 * j).bitwiseAND(63).cast("int")) for j in range(LANES)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(7)), F.lit(blocks))


def bloom_blocks(listed: DataFrame, key: str, count: int) -> tuple[DataFrame, int]:
    """The filter as rows (block, lane0 .. lane7), and the number of blocks."""
    blocks = max(1, -(-count * BITS_PER_URL // 512))
    bits = _bits(F.col(key))
    made = listed.groupBy(_block(F.col(key), blocks).alias("block")).agg(*[F.bit_or(bits[j]).alias(f"lane{j}") for j in range(LANES)])
    return made, blocks


def url_filter(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], *, id_column: str = "page_id", url_column: str = "url", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Each page's host, path, rule, verdict and whether its canonical URL is listed.

    ``listed`` has one string column ``canonical``; nulls and repetitions in it
    don't matter.
    """
    host, path, query = url_parts(F.col(url_column))
    parts = pages.select(F.col(id_column).alias("page_id"), host.alias("host"), path.alias("path"), query.alias("query"))
    parts = parts.withColumn("canonical", canonical_url(F.col("host"), F.col("path"), F.col("query"))).drop("query")
    listed = materialize(listed.select("canonical").where("canonical is not null and canonical <> ''").distinct(), "listed", small=True)
    count = listed.count()
    made, blocks = bloom_blocks(listed, "canonical", count)
    small = blocks * BLOCK_BYTES <= broadcast_bytes
    apart = -1 - F.pmod(F.xxhash64("page_id", "canonical", "path"), F.lit(APART))
    probed = parts.withColumn("block", F.when(F.col("canonical") != "", _block(F.col("canonical"), blocks)).otherwise(apart))
    probed = probed.join(F.broadcast(made) if small else made, "block", "left")
    hit = F.lit(True)
    for j, bit in enumerate(_bits(F.col("canonical"))):
        hit = hit & (F.col(f"lane{j}").bitwiseAND(bit) == bit)
    possible = F.coalesce(hit, F.lit(False))
    probed = probed.select("page_id", "host", "path", F.when(possible, F.col("canonical")).otherwise("").alias("canonical"), F.when(possible, F.lit(0).cast("long")).otherwise(apart).alias("salt"))
    known = listed.withColumn("salt", F.lit(0).cast("long")).withColumn("listed", F.lit(True))
    weight = listed.agg(F.coalesce(F.sum(F.length("canonical") + 64), F.lit(0)).alias("bytes")).first()["bytes"]
    both = probed.join(F.broadcast(known) if weight <= broadcast_bytes else known, ["canonical", "salt"], "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    rule, verdict = first_rule(F.col("host"), F.col("path"), rules)
    return both.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")
