import random

import numpy as np

from loomvec.llm import substrings

SCHEMA = "doc_id long, text string"


def scalar_borders(data: bytes, mask_bits=substrings.MASK_BITS):
    """Borders by the rolling form, byte by byte."""
    h, hits = 0, []
    for i, byte in enumerate(data):
        h = ((h << 1) + int(substrings._gear()[byte])) & 0xFFFFFFFF
        if i >= substrings.WINDOW - 1 and h >> (32 - mask_bits) == 0:
            hits.append(i)
    ends = [i + 1 for k, i in enumerate(hits) if k == 0 or i - hits[k - 1] >= substrings.MIN_CHUNK]
    ends = sorted({*ends, *([len(data)] if data else [])})
    out, start = [], 0
    for end in ends:
        while end - start > substrings.MAX_CHUNK:
            start += substrings.MAX_CHUNK
            out.append(start)
        out.append(end)
        start = end
    return out


def test_borders_as_rolling():
    rng = random.Random(1)
    texts = [bytes(rng.randrange(97, 123) for _ in range(n)) for n in (0, 1, 31, 32, 500, 0, 5000)] + [b"a" * 3000]
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    want = [int(a) + e for a, t in zip(at, texts, strict=False) for e in scalar_borders(t)]
    assert substrings.chunk_borders(data, at).tolist() == want


def test_passages_and_shifts(spark):
    rng = random.Random(2)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    passage, whole = text(55), text(80)
    rows = [(i, text(100)) for i in range(40)]
    rows += [(100 + i, f"{text(rng.randrange(0, 30))} {passage} {text(rng.randrange(0, 30))}") for i in range(20)]
    rows += [(200, whole), (201, whole), (202, "x" + whole)]
    got = substrings.repeated_spans(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id for r in got} == {*range(101, 120), 201, 202}
    assert all(100 <= r.first_doc_id < r.doc_id < 200 or 200 <= r.first_doc_id < r.doc_id for r in got)
    texts = dict(rows)
    for r in got:  # the passage's first chunk stands at its first place too
        chunk = texts[r.doc_id].encode()[r.start :][: substrings.MIN_CHUNK]
        assert texts[r.first_doc_id].encode()[r.first_start :].startswith(chunk)


def brute_spans(rows, min_bytes):
    """All spans from the borders, chunk by chunk in order of document and place."""
    first, out = {}, []
    for doc, text in sorted(rows):
        data = (text or "").encode()
        start, run = 0, None
        for end in scalar_borders(data):
            chunk = data[start:end]
            origin = first.setdefault(chunk, (doc, start))
            if origin == (doc, start):
                run = None
            elif run is not None:
                run[2], run[3] = run[2] + end - start, run[3] + 1
            else:
                run = [doc, start, end - start, 1, *origin]
                out.append((run, len(data)))
            start = end
    return sorted(tuple(r) for r, n in out if r[2] >= min_bytes or r[2] == n)


def test_spans_as_brute_force(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijé") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [text(n) for n in (4, 8, 20, 55, 90)]
    rows = [(i, " ".join([text(rng.randrange(0, 40)), *rng.choices(passages, k=rng.randrange(0, 4)), text(rng.randrange(0, 40))])) for i in range(80)]
    rows += [(100, "tiny"), (101, "tiny"), (102, None), (103, ""), (104, "a" * 700), (105, "a" * 700)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for least in (0, 80):
        got = substrings.repeated_spans(docs, min_bytes=least)
        assert sorted(tuple(r) for r in got.select("doc_id", "start", "length", "n_chunks", "first_doc_id", "first_start").collect()) == brute_spans(rows, least)


def test_defined_cases(spark):
    long = "abc def " * 20_000
    rows = [(1, None), (2, ""), (3, "short"), (4, "short."), (None, "x" * 500), (5, long), (5, long)]
    got = substrings.repeated_spans(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", start int")).collect()
    assert {r.doc_id for r in got} <= {5}
    assert substrings.repeated_spans(spark.createDataFrame([], SCHEMA)).collect() == []
