import hashlib
import random

import pytest
import regex

from loomvec.llm import spotsigs

SCHEMA = "doc_id long, text string"


def test_pattern_is_the_words():
    import re

    pattern = re.compile(f"(?:{spotsigs.words_pattern(spotsigs.ANCHORS)})$")
    assert all(pattern.match(w) for w in spotsigs.ANCHORS)
    assert not any(pattern.match(w) for w in ("th", "thee", "x", "andx"))


def signatures(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r.s for r in spotsigs.spot_signatures(df, "text", "s").orderBy("i").collect()]


def plain(text):
    """The set of (anchor, content word, next content word), one word at a time."""
    words = regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())
    content = [(i, w) for i, w in enumerate(words) if w not in spotsigs.ANCHORS or i == len(words) - 1]
    chains = []
    for (i, w), (_, after) in zip(content, [*content[1:], (0, None)], strict=True):
        chains.append((words[i - 1] if i and words[i - 1] in spotsigs.ANCHORS else None, w, after))
    found = {c for c in chains if c[0]}
    if not words:
        return {text or ""}
    return found if len(found) >= spotsigs.LEAST_SPOTS else found | {(None, w, after) for _, w, after in chains}


def test_whole_table_as_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    got = {r.doc_id: r for r in spotsigs.compare_edited(docs).collect()}
    ring = sorted(texts)
    likeness = lambda a, b: len(a & b) / len(a | b)
    for d, e in zip(ring, ring[1:] + ring[:1], strict=True):
        t, n = texts[d] or "", texts[e] or ""
        k = len(t) // 4
        own, edited, after = plain(t), plain(t[: len(t) - k] + n[:k]), plain(n)
        sets = [set(x.split(".")) for x in (got[d].fingerprint, got[d].edited_fingerprint, got[e].fingerprint)]
        assert [len(x) for x in sets] == [len(own), len(edited), len(after)], d
        assert got[d].near_edited == pytest.approx(likeness(own, edited)) == pytest.approx(likeness(*sets[:2]))
        assert got[d].near_next == pytest.approx(likeness(own, after)) == pytest.approx(likeness(sets[0], sets[2]))


def test_signatures_are_of_content_words(spark):
    filler = " ".join(f"the w{i}" for i in range(30))
    a, b, c, d = signatures(spark, [f"{filler} the cat and the dog", f"{filler} THE  cat, and, the... dog!", f"{filler} the of the cat dog", f"{filler} the cat fish dog"])
    assert a == b and set(a) & set(c) and a != d
    bare = signatures(spark, [f"{filler} " + "qa qb qc " * 9, f"{filler} qa qb qc"])
    assert len(bare[0]) == len(bare[1]) == 30  # no chain without an anchor
    assert signatures(spark, [None, "", "...", "hello"]) == signatures(spark, ["", None, "...", "Hello"])


def test_long_runs_and_repeats(spark):
    got = signatures(spark, ["the " * 60_000 + "cat", "For For For " * 20_000])
    assert all(1 <= len(s) <= 5 for s in got)
    assert all(signatures(spark, [f"{w} " * 40 for w in ("ating", "cat", "x", "zebra", "house")]))


@pytest.mark.parametrize("rows_a_window", [2, 500])
def test_edited_and_next(spark, monkeypatch, rows_a_window):
    monkeypatch.setattr(spotsigs, "BUCKET_ROWS", rows_a_window)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    rows = [(rng.randrange(-10**12, 10**12) if i % 2 else i, " ".join(rng.choice([word(), "the", "of", "é😀"]) for _ in range(rng.randrange(0, 120)))) for i in range(60)]
    rows += [(10**15, None), (10**16, "same text"), (10**17, "same text")]
    got = {r.doc_id: r for r in spotsigs.compare_edited(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    ring = sorted((d, t or "") for d, t in rows)
    edited = []
    for (d, t), (_, n) in zip(ring, ring[1:] + ring[:1], strict=True):
        k = len(t) // 4
        edited.append(t[: len(t) - k] + n[:k])
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(edited[-1].encode()).hexdigest()
    whole, changed = signatures(spark, [t for _, t in ring]), signatures(spark, edited)
    for i, (d, _) in enumerate(ring):
        j = (i + 1) % len(ring)
        of = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
        assert got[d].near_edited == pytest.approx(of(whole[i], changed[i])) and got[d].near_next == pytest.approx(of(whole[i], whole[j]))
    assert got[10**16].fingerprint == got[10**17].fingerprint and got[10**16].near_next == 1.0


def test_defined_cases(spark):
    one = spotsigs.compare_edited(spark.createDataFrame([(5, "abcd", 1)], SCHEMA + ", sigs int")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abca").hexdigest() and one.near_next == 1.0
    null = spotsigs.compare_edited(spark.createDataFrame([(None, "abcdefgh"), (1, "xy")], SCHEMA)).collect()
    assert {r.edited_sha256 for r in null} == {hashlib.sha256(b"abcdef").hexdigest(), hashlib.sha256(b"xy").hexdigest()}
    assert spotsigs.compare_edited(spark.createDataFrame([], SCHEMA)).collect() == []


def test_near_pairs_as_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    pairs, members = spotsigs.near_pairs(docs, 0.7)
    sets = {r.doc_id: frozenset(r.s) for r in spotsigs.spot_signatures(docs, "text", "s").select("doc_id", "s").collect()}
    first = {}
    for d in sorted(sets):
        first.setdefault(sets[d], d)
    assert {r.doc_id: r["class"] for r in members.collect()} == {d: first[s] for d, s in sets.items()}
    reps = sorted((d, s) for s, d in first.items())
    want = {(a, b) for i, (a, x) in enumerate(reps) for b, y in reps[i + 1 :] if len(x & y) >= 0.7 * len(x | y)}
    assert {(r.a, r.b) for r in pairs.collect()} == want


def test_native(spark, sf_dir):
    plan = spotsigs.compare_edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
