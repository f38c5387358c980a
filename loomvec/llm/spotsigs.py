"""SpotSigs fingerprints: chains of content words that follow common words.

Each place where a common word (an anchor) stands before a content word gives
a spot signature: the last anchor of the run, that content word and the next
one, anchors in between left out. A text's fingerprint is the set of its spot
signatures, written out, so that a likeness can be taken from two fingerprints
alone. Only anchored chains count; the one fallback is for texts with fewer
than ``LEAST_SPOTS`` of them (lists, short texts), where the chain at each
content word counts besides. Texts without words have the whole text as their
only signature. Sets are compared by Jaccard; the join partitions them by
length, so that only neighbouring length classes meet, and prunes by prefixes
before it compares.

Everything is DataFrame expressions: a text becomes an array of hashes inside
its row, and nothing is exploded on the main path.

Defined cases: a null text counts as empty; equal texts have equal
fingerprints; two empty texts are alike by 1; a null ``doc_id`` has no next
document, so its edited text just loses the last quarter, and it is nobody's
next; rows of one ``doc_id`` follow each other by text; a table of one row has
itself as its next; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomvec.session import materialize

#: Common words of four languages (fixed values).
ANCHORS = (
    "the of and to a in is that it for was on with as be by this are at from or an have not which but "
    "der die und den von zu das mit sich des für auf im ist nicht dem ein eine als auch es werden "
    "de la le et les en du une que est pour qui dans par sur au pas avec plus il "
    "el y los se del las un por con no su para al lo como más"
).split()
#: Texts with fewer anchored spots have a chain at every content word besides.
LEAST_SPOTS = 8
#: Rows of a window, and the most edges that are held on the driver.
BUCKET_ROWS, EDGES = 128, 4096


def words_pattern(words: list[str]) -> str:
    """A pattern for exactly these words that branches by letter."""
    tree: dict = {}
    for word in words:
        node = tree
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def form(node: dict) -> str:
        parts = [c + form(child) for c, child in sorted(node.items()) if c]
        if not parts:
            return ""
        body = parts[0] if len(parts) == 1 and "" not in node else f"(?:{'|'.join(parts)})"
        return f"{body}?" if "" in node else body

    return form(tree)


def spot_signatures(df: DataFrame, text: str, out: str, anchors: list[str] = ANCHORS, least: int = LEAST_SPOTS) -> DataFrame:
    """``df`` with the sorted distinct hashes of its text's spot signatures; never null, never empty.

    The steps are columns of their own, so that none is computed twice.
    """
    anchor = words_pattern(anchors)
    step = {k: f"_{out}_{k}" for k in ("flat", "glued", "words", "bare", "after", "found")}
    of = lambda k: F.col(step[k])
    made = df.withColumn(step["flat"], F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " ")))
    # The last anchor of a run is glued to the content word behind it.
    made = made.withColumn(step["glued"], F.regexp_replace(of("flat"), rf"(?<![^ ])(?:{anchor} )++(?<=(?<![^ ])({anchor}) )", "$1:"))
    made = made.withColumn(step["words"], F.split(of("glued"), " ")).withColumn(step["bare"], F.split(F.regexp_replace(of("glued"), r"[^ :]+:", ""), " "))
    made = made.withColumn(step["after"], F.slice(of("bare"), 2, F.greatest(F.size(of("bare")), F.lit(1))))
    made = made.withColumn(step["found"], F.array_distinct(F.array_compact(F.zip_with(of("words"), of("after"), lambda w, c: F.when(F.contains(w, F.lit(":")), F.hash(w, c))))))
    every = F.array_distinct(F.concat(of("found"), F.zip_with(of("bare"), of("after"), lambda w, c: F.hash(w, c))))
    signatures = F.when(of("flat") == "", F.array(F.hash(F.coalesce(F.col(text), F.lit(""))))).when(F.size(of("found")) >= least, of("found")).otherwise(every)
    return made.withColumn(out, F.sort_array(signatures)).drop(*step.values())


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two sets of distinct hashes."""
    common = F.size(F.array_intersect(a, b))
    return common.cast("double") / (F.size(a) + F.size(b) - common).cast("double")


def fingerprint(signatures: Column) -> Column:
    """A set as text: its members in order, as hexadecimal numbers between dots."""
    return F.array_join(F.transform(signatures, lambda x: F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF))), ".")


def _edges(ids: DataFrame, rows: int) -> list[int]:
    """Rising ids that cut the table into about equal parts, at most ``EDGES`` of them."""
    n = min(EDGES, rows // BUCKET_ROWS)
    if n < 2:
        return []
    cut = ids.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 4 * n).alias("p")).first()["p"]
    return sorted(set(cut))


def _splits(edges: list[int], rows: int) -> int:
    """Windows between two edges."""
    return max(1, rows // (len(edges) * 4 * BUCKET_ROWS)) if edges else 1


def _bucket(doc_id: Column, edges: list[int], rows: int) -> Column:
    """Part of the id's range, split evenly further where parts would be long. Rises with the id."""
    if not edges:
        return F.lit(0).cast("long")
    width = 1 << (len(edges)).bit_length()
    padded = F.array(*[F.lit(e).cast("long") for e in edges])
    steps = F.array(*[F.lit(width >> k) for k in range(1, width.bit_length())])
    at = F.aggregate(steps, F.lit(0), lambda lo, step: F.when((lo + step <= len(edges)) & (F.get(padded, lo + step - 1) <= doc_id), lo + step).otherwise(lo))
    split = _splits(edges, rows)
    if split == 1:
        return at.cast("long")
    low, high = F.get(padded, at - 1).cast("double"), F.get(padded, at).cast("double")
    inner = F.least(F.lit(split - 1), F.floor((doc_id.cast("double") - low) / (high - low) * split))
    return at.cast("long") * split + F.coalesce(inner, F.lit(0)).cast("long")


def with_next(docs: DataFrame, carried: list[str], prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``next_<c>`` of the following row by doc_id, the first after the last.

    The id range is cut into windows; the first row of a window also stands at
    the end of the one before it. ``prepare`` adds columns to every row that
    enters a window, those that stand twice included.
    """
    ids = docs.where("doc_id is not null").select("doc_id")
    rows = ids.count()
    edges = _edges(ids, rows)
    bucket = _bucket(F.col("doc_id"), edges, rows)
    firsts = ids.groupBy(bucket.alias("_bucket")).agg(F.min("doc_id").alias("_first"))
    # The window before each: within the range between two edges, else the last one of the range before.
    ranges = firsts.withColumn("_range", F.floor(F.col("_bucket") / F.lit(_splits(edges, rows))))
    lasts = ranges.groupBy("_range").agg(F.max("_bucket").alias("_last"))  # a row for each edge at most
    order = Window.orderBy("_range")
    lasts = lasts.select("_range", F.coalesce(F.lag("_last").over(order), F.max("_last").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_ended"))
    within = Window.partitionBy("_range").orderBy("_bucket")
    firsts = ranges.withColumn("_lag", F.lag("_bucket").over(within)).join(F.broadcast(lasts), "_range")
    firsts = materialize(firsts.select("_first", F.coalesce("_lag", "_ended").alias("_before")), "firsts", small=True)
    few = rows <= BUCKET_ROWS * (1 << 16)  # then there are at most so many windows
    again = docs.join(F.broadcast(firsts) if few else firsts, F.col("doc_id") == F.col("_first")).select(*docs.columns, F.col("_before").alias("_bucket"), F.lit(1).alias("_extra"))
    away = -1 - F.pmod(F.xxhash64("text"), F.lit(1024))  # rows without an id stand apart
    own = docs.withColumn("_bucket", F.coalesce(bucket, away)).withColumn("_bucket", F.when(F.col("doc_id").isNull(), away).otherwise(F.col("_bucket"))).withColumn("_extra", F.lit(0))
    line = Window.partitionBy("_bucket").orderBy("_extra", "doc_id", "text")
    both = prepare(own.unionByName(again))
    for c in carried:
        both = both.withColumn(f"next_{c}", F.when(F.col("doc_id").isNotNull(), F.lead(c).over(line)))
    return both.where("_extra = 0").drop("_bucket", "_extra")


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness, and that to the next document's."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = with_next(docs, ["text", "sigs"], lambda df: spot_signatures(df, "text", "sigs"))
    n = F.char_length("text")
    cut = F.floor(n / F.lit(4)).cast("int")
    edited = F.concat(F.substr(F.col("text"), F.lit(1), n - cut), F.coalesce(F.substr(F.col("next_text"), F.lit(1), cut), F.lit("")))
    found = found.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sigs", "next_sigs")
    found = found.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "edited", "sigs", "next_sigs")
    found = spot_signatures(found, "edited", "edited_sigs")
    return found.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), F.coalesce(likeness(F.col("sigs"), F.col("next_sigs")), F.lit(0.0)).alias("near_next"),
    )


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, likeness) between classes of equal fingerprints, and the classes (doc_id, class).

    A set meets those of its own and of the next length class; of its sorted
    hashes only the prefix that two similar sets must share an element of is
    used. Exact. ``class`` is the smallest doc_id of equal fingerprints.
    """
    made = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = spot_signatures(made, "text", "sigs").drop("text").withColumn("digest", F.md5(fingerprint(F.col("sigs")).cast("binary")))
    classes = made.groupBy("digest").agg(F.min("doc_id").alias("class"))
    members = made.select("doc_id", "digest").join(classes, "digest").select("doc_id", "class")
    reps = materialize(made.groupBy("digest").agg(F.min("doc_id").alias("id"), F.any_value("sigs").alias("sigs")).select("id", "sigs"), "spot-classes")
    size = F.size("sigs")
    step = -math.log(threshold) + 1e-9
    band = F.floor(F.log(size.cast("double")) / step).cast("int")
    prefix = F.slice("sigs", 1, (size - F.ceil(size * threshold - 1e-9) + 1).cast("int"))
    keys = reps.select("id", size.alias("n"), band.alias("band"), F.explode(prefix).alias("key"))
    left = keys.select(F.col("id").alias("a"), F.col("n").alias("na"), "band", "key")
    right = keys.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.explode(F.array("band", F.col("band") - 1)).alias("band"), "key")
    pairs = left.join(right, ["band", "key"]).where((F.col("a") != F.col("b")) & (F.col("na") >= threshold * F.col("nb") - 1e-9) & (F.col("nb") >= threshold * F.col("na") - 1e-9))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    full = pairs.join(reps.select(F.col("id").alias("a"), F.col("sigs").alias("sa")), "a").join(reps.select(F.col("id").alias("b"), F.col("sigs").alias("sb")), "b")
    return full.select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness")).where(F.col("likeness") >= threshold - 1e-12), members
