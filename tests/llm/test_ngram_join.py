import random

import numpy as np
import pytest

from loomvec.llm import ngram_join
from tests.llm.brute import jaccard_groups

SCHEMA = "doc_id long, text string"


def result(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df).collect())


def test_whole_table_as_brute_force(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert result(docs) == jaccard_groups([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("most", [1000, 1 << 21])
def test_common_passages_and_near_copies(spark, most):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    passage, base = [word() for _ in range(60)], [word() for _ in range(90)]
    rows = []
    for i in range(150):
        own = [word() for _ in range(rng.randrange(5, 90))]
        rows.append((i, " ".join(own[:20] + passage + own[20:])))
    for i in range(150, 300):
        text = list(base)
        for _ in range(rng.randrange(0, 4)):
            text[rng.randrange(90)] = word()
        rows.append((i, " ".join(text)))
    for i in range(300, 330):  # short sets, and pairs near the limit
        rows.append((i, " ".join(base[: 5 + i % 9])))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, SCHEMA), most=most).collect())
    assert got == jaccard_groups(rows)


def test_signatures_are_of_subsets_of_partitions():
    rng = np.random.default_rng(5)
    sets = [np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (40, 38, 200, 7)]
    hashes, at = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    band = ngram_join._instances(np.diff(at), 0)
    sig, row, spare = ngram_join.signatures(hashes, at, band, 1, 1.25)
    need, n = ngram_join.first_level(band, 1.25)
    for r, own in enumerate(sets):  # the same, one shingle at a time
        k = int(ngram_join.band_tops()[band[r]]) * 20 // 80
        assert need[r] == k // 2 + 1 and n[r] == -(-5 * int(need[r]) // 4)
        salt = ngram_join.mix64(np.array([int(band[r]) * 2654435761 + 1], np.uint64))
        cells = {}
        for x in own:
            drawn = ngram_join.mix64(np.array([x]) ^ salt)
            cells.setdefault((int(drawn[0]) >> 32) * int(3 * n[r]) >> 32, []).append(int(ngram_join.mix64(drawn + np.uint64(0x51ED270B))[0]))
        filled = [sum(3 * p + j in cells for j in range(3)) for p in range(n[r])]
        assert spare[r] == sum(f >= 2 for f in filled) - need[r]
        contents = [tuple(sorted(v for j in range(3) if j != out for v in cells.get(3 * p + j, []))) for p in range(n[r]) for out in range(3)]
        assert len(set(sig[row == r].tolist())) == len({c for c in contents if c})
        assert {int(s) >> 1 & ngram_join.TAGS for s in sig[row == r]} == {p for p in range(n[r]) if filled[p]}


def test_partners_meet_under_a_needed_signature():
    """Whatever sizes the groups have, two similar sets keep one common signature."""
    rng = np.random.default_rng(6)
    met = 0
    for trial in range(300):
        common = rng.integers(0, 1 << 63, int(rng.integers(20, 120))).astype(np.uint64)
        k = int(rng.integers(0, len(common) // 4 + 1))
        a, b = np.sort(np.append(common, rng.integers(0, 1 << 63, k // 2).astype(np.uint64))), np.sort(np.append(common, rng.integers(0, 1 << 63, k - k // 2).astype(np.uint64)))
        if 100 * len(common) < 80 * (len(common) + k):
            continue
        hashes, at = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
        low = min(ngram_join._instances(np.diff(at), 0))
        band = np.array([low, low])
        sig, row, spare = ngram_join.signatures(hashes, at, band, 1, 1.25)
        kept = []
        for r in (0, 1):
            own = np.unique(sig[row == r]).view(np.int64)
            size = ngram_join.mix64(own.view(np.uint64) + np.uint64(trial)).astype(np.int64) % 7
            kept.append(set(own[ngram_join.needed(own, size, spare[r], ngram_join.first_level(band, 1.25)[1][r])].tolist()))
        if min(spare) >= 0:
            met += 1
            assert kept[0] & kept[1]
    assert met > 50


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "A  b"), (6, "a b c"), (7, "x" * 200_000), (8, "a b\x0bc"), (8, "a b\x0bc")]
    assert result(spark.createDataFrame(rows, SCHEMA)) == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 7), (8, 1, 6), (8, 1, 6)]
    assert ngram_join.jaccard_components(spark.createDataFrame([], SCHEMA)).collect() == []
    null = ngram_join.jaccard_components(spark.createDataFrame([(None, "a b c", 5), (1, "a b c", 6)], SCHEMA + ", id long"))
    assert sorted((r.doc_id or 0, r.component_id) for r in null.collect()) == [(0, None), (1, 1)]


def test_one_of_each_group(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", 1), (2, "a b c", "x", 2), (3, "d", "y", 3), (3, "c d", "z", 4), (4, None, None, 5), (None, "a b c", None, 6)], SCHEMA + ", id string, component_id int")
    kept = ngram_join.one_of_each_group(docs, ngram_join.jaccard_components(docs))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.id, r.component_id) for r in kept.collect()) == [(0, None, 6), (1, "x", 1), (3, "z", 4), (4, None, 5)]
