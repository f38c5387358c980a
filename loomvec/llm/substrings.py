"""Substring deduplication by content-defined chunks.

A gear rolling hash over the UTF-8 bytes (32-byte window, computed for all
positions at once by doubling) sets the chunk borders, so an insertion moves
only the chunks it touches. A border needs its condition alone in the few
bytes before it, which bounds the shortest chunk without a scan from the left;
long stretches without a border are cut at fixed steps from the last one.
Chunks are deduplicated by a 128-bit digest: the first one, by document and
position, is the original, every later one a repetition.

Chunks are cut once and kept in a table. Digests are counted with a map-side
combine, and only those that repeat are joined back, a join whose one side is
unique by key, which the planner splits where one chunk is very common.
Neighbouring repeated chunks of a document are merged into spans. Spans of at
least ``min_bytes`` are returned with the first document that holds their
content, and so are spans that fill a whole document, however short.

Defined cases: null and empty texts have no chunks; a document that repeats
its own passage reports it too; a row without ``doc_id`` is left out; rows of
one ``doc_id`` with equal text count once; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomvec.llm.textarrays import PolyHash, slices
from loomvec.session import materialize

WINDOW = 32
MASK_BITS = 5
MIN_CHUNK, MAX_CHUNK = 16, 256
MIN_BYTES = 80


@lru_cache
def _gear() -> np.ndarray:
    return np.random.default_rng(77).integers(0, 1 << 32, 256, dtype=np.uint32)


@lru_cache
def _hashers() -> tuple[PolyHash, PolyHash]:
    return PolyHash(21), PolyHash(22)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """Value at each byte of h = (h << 1) + gear[byte], over the last 32 bytes."""
    h, width = _gear()[data], 1
    while width < WINDOW:
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    return h


def chunk_borders(data: np.ndarray, at: np.ndarray, mask_bits: int = MASK_BITS, min_chunk: int = MIN_CHUNK, max_chunk: int = MAX_CHUNK) -> np.ndarray:
    """Ends of all chunks, those of each document included, ascending."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    hit = gear_hash(data) >> np.uint32(32 - mask_bits) == 0
    # The first bytes of a document have no whole window of their own.
    begin = np.repeat(at[:-1], np.diff(at))
    hit &= np.arange(n) - begin >= WINDOW - 1
    where = np.flatnonzero(hit)
    alone = np.ones(len(where), bool)
    alone[1:] = np.diff(where) >= min_chunk
    ends = np.union1d(where[alone] + 1, at[1:][np.diff(at) > 0])
    starts = np.concatenate([[0], ends[:-1]])
    extra = (ends - starts - 1) // max_chunk
    if extra.any():
        step = np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + 1
        ends = np.union1d(ends, np.repeat(starts, extra) + step * max_chunk)
    return ends


def chunks(docs: DataFrame, mask_bits: int = MASK_BITS, min_chunk: int = MIN_CHUNK, max_chunk: int = MAX_CHUNK) -> DataFrame:
    """doc_id, start, length (bytes), whether it is its document's last, and digest (lo, hi) of every chunk."""

    def run(batches):
        one, two = _hashers()
        for records in batches:
            doc = records.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, last, data, at in slices(records.column(1)):
                ends = chunk_borders(data, at, mask_bits, min_chunk, max_chunk)
                if not len(ends):
                    continue
                starts = np.concatenate([[0], ends[:-1]])
                row = np.searchsorted(at, starts, side="right") - 1
                lo = one.spans(one.sums(data), starts, ends).view(np.int64)
                hi = two.spans(two.sums(data), starts, ends).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(doc[first:last][row]), pa.array((starts - at[row]).astype(np.int32)), pa.array((ends - starts).astype(np.int32)), pa.array(ends == at[row + 1]), pa.array(lo), pa.array(hi)], names=["doc_id", "start", "length", "last", "lo", "hi"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null").mapInArrow(run, "doc_id long, start int, length int, last boolean, lo long, hi long")


def repeated_spans(docs: DataFrame, *, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Every repeated passage: doc_id, start, length (bytes), n_chunks, first_doc_id, first_start.

    ``first_doc_id`` and ``first_start`` say where the passage's first chunk
    stands for the first time.
    """
    made = materialize(chunks(docs), "chunks")
    # The place of a chunk as one sortable struct; repeated rows of one document fall together.
    known = made.groupBy("lo", "hi").agg(F.min(F.struct("doc_id", "start")).alias("origin"), F.max(F.struct("doc_id", "start")).alias("final"))
    known = known.where("origin <> final").select(F.col("lo").alias("l"), F.col("hi").alias("h"), "origin")
    again = made.join(known, (F.col("lo") == F.col("l")) & (F.col("hi") == F.col("h")))
    again = again.where(F.struct("doc_id", "start") != F.col("origin")).select("doc_id", "start", "length", "last", "origin").distinct()
    order = Window.partitionBy("doc_id").orderBy("start")
    apart = F.coalesce((F.lag("start").over(order) + F.lag("length").over(order) != F.col("start")).cast("int"), F.lit(1))
    spans = again.withColumn("apart", apart).withColumn("span", F.sum("apart").over(order))
    spans = spans.groupBy("doc_id", "span").agg(F.min("start").alias("start"), F.sum("length").alias("length"), F.count("*").alias("n_chunks"), F.min_by("origin", "start").alias("origin"), F.max("last").alias("last"))
    return spans.where((F.col("length") >= min_bytes) | ((F.col("start") == 0) & F.col("last"))).select("doc_id", F.col("start").cast("long").alias("start"), "length", "n_chunks", F.col("origin.doc_id").alias("first_doc_id"), F.col("origin.start").cast("long").alias("first_start"))
