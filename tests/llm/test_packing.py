import random
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loomvec.llm import packing

SCHEMA = "doc_id long, text string"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_assignment_is_whole_and_tight(lengths):
    rows = packing.assign(np.array(lengths, np.int64), 100, 1.0, 0.01)
    bins = -(-sum(lengths) // 100)
    room, pieces = defaultdict(list), defaultdict(list)
    for i, start, n, b, offset in rows:
        pieces[i].append((start, n))
        room[b].append((offset, n))
    assert len(room) <= bins
    for i, n in enumerate(lengths):
        at = 0
        for start, size in sorted(pieces[i]):
            assert start == at and size > 0
            at += size
        assert at == n
    for spans in room.values():
        at = 0
        for offset, size in sorted(spans):
            assert offset == at
            at += size
        assert at <= 100


def plain_greedy(lengths, capacity, linear, quadratic):
    """The rule with loops: descending, to the cheapest sequence with room, else into the room that is left."""
    bins = [[0, 0.0] for _ in range(-(-sum(lengths) // capacity))]  # filled, cost
    out = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        left, start = lengths[i], 0
        while left:
            fits = [b for b in range(len(bins)) if capacity - bins[b][0] >= left and not start]
            b = min(fits, key=lambda b: bins[b][1]) if fits else min(range(len(bins)), key=lambda b: bins[b][0])
            take = min(left, capacity - bins[b][0])
            out.append((i, start, take, b, bins[b][0]))
            bins[b][0] += take
            bins[b][1] += linear * take + quadratic * take * take
            start, left = start + take, left - take
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=50))
def test_assignment_as_plain_greedy(lengths):
    assert packing.assign(np.array(lengths, np.int64), 64, 1.0, 1 / 64) == plain_greedy(lengths, 64, 1.0, 1 / 64)


def test_ids_as_the_tokenizer_file():
    from tokenizers import Tokenizer

    import public_tokenizers

    tokenizer, encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.public_encoder()
    rng = random.Random(1)
    kinds = ["abcdefgh THE", "äöüßéñ ", "\n\t\r\x0b ", "0123456789.,-", "日本語テキスト", "😀👩‍👧🏽\u0301", "'s't'll \u00a0\u2028", "\x00\x7f\ufeff"]
    for _ in range(4000):
        text = "".join(rng.choice(rng.choice(kinds)) if rng.random() < 0.9 else chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(rng.randrange(0, 40)))
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_equal_lengths_balance_cost():
    rows = packing.assign(np.array([50] * 4 + [25] * 8, np.int64), 100, 1.0, 1.0)
    cost = defaultdict(float)
    for _, _, n, b, _ in rows:
        cost[b] += n + n * n
    assert len(cost) == 4 and max(cost.values()) == min(cost.values())


def test_every_id_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(docs.select("doc_id", "text").collect(), packing.pack(docs, window_tokens=20_000).collect())


def check(docs, rows):
    from tokenizers import Tokenizer

    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc_id, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for spans in sequences.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding / (2048 * len(sequences)) if sequences else 0.0


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, "a <|endoftext|> b"), (4, "word " * 6000), (5, "é\x00😀")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], SCHEMA + ", length long")
    check(rows, packing.pack(docs).collect())
    assert packing.pack(spark.createDataFrame([], SCHEMA)).collect() == []
    twice = packing.pack(spark.createDataFrame([(1, "x y"), (1, "x y"), (None, "z")], SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.start) for r in twice) == [(0, 0), (1, 0), (1, 0)]
