"""Cost-balanced packing of documents into training sequences.

A document's attention cost is estimated as ``linear * tokens + quadratic *
tokens**2``. Within a bounded window of documents, pieces are taken by
descending cost and each goes to the sequence of lowest cost so far that still
has room for it; a piece that fits nowhere is cut into the room that is left.
Windows are packed where the documents are read: nothing is shuffled, and no
key, source or copy group can gather in one task.

Defined cases: a null text counts as empty and becomes the single end id; a
null ``doc_id`` is kept; equal or repeated rows are packed each on its own; an
empty table gives no rows; a document longer than a sequence is cut into full
sequences first; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from loomvec.llm.textarrays import release_memory, steady_memory

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"
#: Tokens that are packed together; about 500 sequences.
WINDOW_TOKENS = 1 << 20
#: Special strings that the tokenizer file itself turns into one id.
SPECIAL = "<|endoftext|>"


class Encoder:
    """ids as the tokenizer file gives them.

    The ranks file beside it holds the same vocabulary and gives the same ids
    several times faster; texts with a special token's string go through the
    tokenizer file itself.
    """

    def __init__(self, tokenizer_file: str, ranks_file: str | None, pattern: str | None):
        self.tokenizer_file, self.whole, self.fast = tokenizer_file, None, None
        if ranks_file and os.path.exists(ranks_file) and pattern:
            import tiktoken

            with open(ranks_file, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and SPECIAL not in text:
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        if self.whole is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.tokenizer_file)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache
def public_encoder(name: str = "byte_bpe_50k") -> Encoder:
    import public_tokenizers as public

    return Encoder(public.path(f"{name}.json"), public.path(f"{name}.tiktoken"), public.PATTERN)


def assign(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(piece, start within it, length, sequence, offset) for every token.

    Descending pieces go to the lowest-cost sequence with room; as many
    sequences are opened as the tokens need, so that less than one sequence
    of room is left over.
    """
    total = int(lengths.sum())
    if not total:
        return []
    bins = -(-total // capacity)
    room, cost = np.full(bins, capacity, np.int64), np.zeros(bins)
    out = []
    for i in np.argsort(-lengths, kind="stable"):
        left, start = int(lengths[i]), 0
        fits = room >= left
        if fits.any():
            b = int(np.argmin(np.where(fits, cost, np.inf)))
            parts = [(b, left)]
        else:
            parts = []
            for b in np.argsort(-room, kind="stable"):
                if not left:
                    break
                take = min(left, int(room[b]))
                parts.append((int(b), take))
                left -= take
        for b, take in parts:
            out.append((int(i), start, take, b, int(capacity - room[b])))
            room[b] -= take
            cost[b] += linear * take + quadratic * take * take
            start += take
    return out


def pack(docs: DataFrame, *, capacity: int = 2048, linear: float = 1.0, quadratic: float = 1.0 / 2048, end_id: int = 1, encoder: str = "byte_bpe_50k", window_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """One row for each piece of each document's ids, with its place in a sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_memory()
        encode = public_encoder(encoder)
        context = TaskContext.get()
        next_id = (context.partitionId() if context else 0) << 36
        held: list[tuple[int | None, np.ndarray, int]] = []  # doc, ids of its last piece, start of that piece
        out: list[tuple] = []
        waiting = 0

        def row(doc, ids, start, total, sequence, offset):
            n = len(ids)
            return doc, start, n, zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()), total, sequence, offset, linear * n + quadratic * n * n

        def flush():
            nonlocal next_id, waiting
            lengths = np.array([len(ids) for _, ids, _ in held], np.int64)
            for i, start, take, b, offset in assign(lengths, capacity, linear, quadratic):
                doc, ids, at = held[i]
                out.append(row(doc, ids[start : start + take], at + start, at + len(ids), next_id + b, offset))
            next_id += -(-int(lengths.sum()) // capacity) if len(held) else 0
            held.clear()
            waiting = 0

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.float64() if k == 7 else pa.int64()) for k in range(8)], names=[x.split()[0] for x in SCHEMA.split(", ")])
            out.clear()
            return made

        for records in batches:
            for doc, text in zip(records.column(0).to_pylist(), records.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id))
                full = len(ids) // capacity * capacity
                for start in range(0, full, capacity):
                    out.append(row(doc, ids[start : start + capacity], start, len(ids), next_id, 0))
                    next_id += 1
                if full < len(ids):
                    held.append((doc, ids[full:], full))
                    waiting += len(ids) - full
                if waiting >= window_tokens:
                    flush()
                if len(out) >= 5_000:
                    yield batch()
        flush()
        yield batch()
        release_memory()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA)
