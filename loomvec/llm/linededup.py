"""Line deduplication: equal lines, and lines within one edit of each other.

The deletion neighbourhood of a line holds the line itself and every variant
with one code point left out. Two lines are within one edit exactly if they
leave the same rest at the same position (a substitution), or if one is a
variant of the other (an insertion). So variants are emitted as hashed keys
with the position, equal keys meet, and the candidates' edit distance is
verified on the texts. A line goes if an earlier line, by document and line
number, is equal or within the bound; the earliest stays.

Emitting all variants of all lines would be many times the input. Two lines
within one edit share their first or their second half, cut by the shorter
length, so only lines whose half occurs in another line of fitting length emit
variants: none that matter are lost.

Equal lines are found by an aggregation with a map-side combine and a join
whose one side is unique, which the planner splits for a very common line.
Distinct lines of one key differ in a single code point there, so the groups
that meet stay small whatever the input.

Defined cases: lines of nothing but space stay, however often they occur, and
all others take part, whatever their length (``min_chars`` and ``min_near``
raise that, for equal lines and for near ones); null texts stay null; rows
that agree in ``doc_id`` and text are one document; a null ``doc_id`` is the
earliest; an empty table gives no rows; further columns are kept, whatever
their names, but for ``lines_dropped``.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomvec.llm.textarrays import PolyHash, mix64, slices
from loomvec.session import materialize, small_batches

MIN_CHARS, MIN_NEAR = 0, 0
#: Bytes that are broadcast at most; beyond that a shuffle join is used.
BROADCAST_BYTES = 48 << 20
_PLACE = "doc_id long, mark long"
LINES = f"{_PLACE}, line int, chars int, lo long, hi long, keys array<long>"
VARIANTS = f"{_PLACE}, line int, at int, lo long, hi long"


@lru_cache
def _hashers() -> tuple[PolyHash, PolyHash]:
    return PolyHash(31), PolyHash(32)


def _code_points(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slice as code points, and the documents' offsets in them."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    count = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])
    return points, count[at]


def _lines(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, number within the row) of all lines."""
    rows = len(at) - 1
    cuts = np.flatnonzero(points == 10)
    owner = np.searchsorted(at, cuts, side="right") - 1
    start = np.concatenate([at[:-1], cuts + 1])
    end = np.concatenate([at[1:], cuts])
    row = np.concatenate([np.arange(rows), owner])
    order = np.lexsort((start, row))
    start, row = start[order], row[order]
    end = np.sort(end[np.lexsort((end, np.concatenate([np.arange(rows), owner])))])
    counts = np.bincount(row, minlength=rows)
    return start, end, row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def line_table(docs: DataFrame, min_chars: int, min_near: int) -> DataFrame:
    """Hash and half keys of every line that takes part; ``docs``: doc_id, mark, text."""

    def run(batches):
        one, two = _hashers()
        for records in batches:
            doc, mark = records.column(0), records.column(1)
            for first, last, data, at in slices(records.column(2)):
                points, at = _code_points(data, at)
                start, end, row, number = _lines(points, at)
                chars = end - start
                solid = np.concatenate([[0], np.cumsum((points > 32) | ((points < 32) & ((points < 9) | (points > 13))))])
                keep = (chars >= min_chars) & (solid[end] > solid[start])
                start, end, row, number, chars = (x[keep] for x in (start, end, row, number, chars))
                sums = one.sums(points)
                lo, hi = one.spans(sums, start, end), two.spans(two.sums(points), start, end)
                near = chars >= min_near
                s, e, n = start[near], end[near], chars[near]
                keys = np.zeros((len(s), 4), np.uint64)
                for j, m in enumerate((n, n - 1)):
                    half = m // 2
                    tag = mix64(m.astype(np.uint64))
                    keys[:, 2 * j] = mix64(one.spans(sums, s, s + half) ^ tag)
                    keys[:, 2 * j + 1] = mix64(one.spans(sums, e - (m - half), e) ^ tag + np.uint64(1))
                pick = pa.array(first + row)
                offsets = np.concatenate([[0], np.cumsum(near * 4)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([doc.take(pick), mark.take(pick), pa.array(number.astype(np.int32)), pa.array(chars.astype(np.int32)), pa.array(lo.view(np.int64)), pa.array(hi.view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1).view(np.int64)))], names=[x.split()[0] for x in LINES.split(", ")])

    return docs.mapInArrow(run, LINES)


def _variants(docs: DataFrame) -> DataFrame:
    """The deletion neighbourhood of the wanted lines; ``docs``: doc_id, mark, text, wanted (line numbers)."""

    def run(batches):
        one, two = _hashers()
        for records in batches:
            wanted = records.column(3)
            for first, last, data, at in slices(records.column(2), 1 << 18):
                points, at = _code_points(data, at)
                start, end, row, number = _lines(points, at)
                ask = np.zeros(len(row), bool)
                begins = np.searchsorted(row, np.arange(last - first))
                for r in range(first, last):
                    ask[begins[r - first] + wanted[r].values.to_numpy()] = True
                start, end, row, number = (x[ask] for x in (start, end, row, number))
                n = end - start
                line = np.repeat(np.arange(len(n)), n + 1)
                i = np.arange(len(line)) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1) - 1  # -1: the line itself
                s, e, cut = start[line], end[line], np.maximum(start[line] + i, start[line])
                after = np.where(i < 0, cut, cut + 1)
                out = []
                for hasher in (one, two):
                    sums = hasher.sums(points)
                    tail = hasher.raw(sums, after, e) * hasher.powers[cut - s]
                    out.append(mix64(hasher.raw(sums, s, cut) + tail + (n[line] - (i >= 0)).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)).view(np.int64))
                pick = pa.array(first + row[line])
                yield pa.RecordBatch.from_arrays([records.column(0).take(pick), records.column(1).take(pick), pa.array(number[line].astype(np.int32)), pa.array(i.astype(np.int32)), *map(pa.array, out)], names=[x.split()[0] for x in VARIANTS.split(", ")])

    return docs.mapInArrow(run, VARIANTS)


def _few(df: DataFrame, array: str | None = None) -> DataFrame:
    """``df``, to be broadcast only while its rows and the numbers in its ``array`` are known to be few."""
    numbers = F.size(array) if array else F.lit(0)
    weight = df.agg(F.coalesce(F.sum(64 + 8 * numbers), F.lit(0)).alias("bytes")).first()["bytes"]
    return F.broadcast(df) if weight <= BROADCAST_BYTES else df


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.mark") == F.col(f"{b}.mark"))


def repeated_lines(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_near: int = MIN_NEAR) -> DataFrame:
    """doc_id, mark, line of every line to drop, with the earlier line (``first``) it repeats.

    ``mark`` is xxhash64 of the text; it tells rows of one ``doc_id`` apart.
    """
    with small_batches(docs.sparkSession):
        return _repeated_lines(docs, min_chars, min_near)


def _repeated_lines(docs: DataFrame, min_chars: int, min_near: int) -> DataFrame:
    docs = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    lines = materialize(line_table(docs, min_chars, min_near), "lines")
    place = F.struct("doc_id", "mark", "line")
    unique = lines.groupBy("lo", "hi").agg(F.min(place).alias("first"), F.max(place).alias("final"), F.any_value("keys").alias("keys"))
    unique = materialize(unique, "unique-lines")
    common = unique.where("first <> final").select(F.col("lo").alias("l"), F.col("hi").alias("h"), "first")
    equal = lines.join(common, (F.col("lo") == F.col("l")) & (F.col("hi") == F.col("h"))).where(place != F.col("first"))
    equal = equal.select("doc_id", "mark", "line", "first", F.lit(True).alias("exact"))
    # Lines that share a half with another line of fitting length.
    halves = unique.select(F.explode("keys").alias("key"), "lo", "first")
    shared = materialize(halves.groupBy("key").agg(F.min("lo").alias("a"), F.max("lo").alias("b")).where("a <> b").select("key"), "halves", small=True)
    wanted = halves.join(_few(shared), "key", "left_semi").select("first.*").distinct()
    wanted = materialize(wanted.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_list("line")).alias("wanted")), "wanted", small=True)
    asked = docs.alias("d").join(_few(wanted, "wanted").alias("w"), _same("d", "w")).select("d.doc_id", "d.mark", "d.text", "w.wanted")
    asked = asked.dropDuplicates(["doc_id", "mark"]) if _repeats(docs) else asked
    variants = _variants(asked).withColumn("place", place)
    rest = Window.partitionBy("lo", "hi")
    here = Window.partitionBy("lo", "hi", "at")
    other = F.when(F.col("at") < 0, F.min(F.when(F.col("at") >= 0, F.col("place"))).over(rest)).otherwise(F.least(F.min("place").over(here), F.coalesce(F.min(F.when(F.col("at") < 0, F.col("place"))).over(rest), F.col("place"))))
    near = variants.withColumn("first", other).where("first < place").select("doc_id", "mark", "line", "first")
    near = materialize(near.groupBy("doc_id", "mark", "line").agg(F.min("first").alias("first")), "near-lines", small=True)
    return equal.unionByName(materialize(_verified(docs, near), "verified", small=True).withColumn("exact", F.lit(False)))


def _repeats(docs: DataFrame) -> bool:
    return bool(docs.groupBy("doc_id", "mark").count().where("count > 1").limit(1).count())


def _verified(docs: DataFrame, near: DataFrame) -> DataFrame:
    """The candidates whose edit distance is at most one."""
    places = near.select("doc_id", "mark", "line").unionByName(near.select("first.*")).distinct()
    places = materialize(places.groupBy("doc_id", "mark").agg(F.collect_set("line").alias("numbers")), "places", small=True)
    texts = docs.alias("d").join(_few(places, "numbers").alias("p"), _same("d", "p")).select("d.doc_id", "d.mark", F.explode("p.numbers").alias("line"), F.split("d.text", "\n", -1).alias("all"))
    texts = texts.select("doc_id", "mark", "line", F.get("all", F.col("line")).alias("value")).distinct()
    own = near.alias("n").join(texts.alias("t"), _same("n", "t") & (F.col("n.line") == F.col("t.line"))).select("n.doc_id", "n.mark", "n.line", "n.first", F.col("t.value").alias("mine"))
    both = own.join(texts.alias("t"), F.col("first.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("first.mark") == F.col("t.mark")) & (F.col("first.line") == F.col("t.line")))
    close = F.levenshtein("mine", "t.value", 1)
    return both.where(close >= 0).select(own["doc_id"], own["mark"], own["line"], "first")


def dedup_lines(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_near: int = MIN_NEAR) -> DataFrame:
    """``docs`` with the repeated lines left out of ``text``, and ``lines_dropped``."""
    drops = repeated_lines(docs, min_chars=min_chars, min_near=min_near)
    drops = materialize(drops.groupBy("doc_id", "mark").agg(F.collect_set("line").alias("gone")), "drops")
    kept_columns = [c for c in docs.columns if c != "lines_dropped"]
    # The input's columns travel in one struct, so that none can clash.
    marked = docs.select(F.struct(*kept_columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"))
    found = marked.alias("d").join(_few(drops, "gone").alias("g"), _same("d", "g"), "left").select("row", "gone")
    kept = F.array_join(F.filter(F.split("row.text", "\n", -1), lambda _, i: ~F.array_contains("gone", i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(kept)
    return found.select(*[(text if c == "text" else F.col("row").getField(c)).alias(c) for c in kept_columns], F.coalesce(F.size("gone"), F.lit(0)).alias("lines_dropped"))
