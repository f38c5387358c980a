from collections import Counter

import corpus_pipeline as pipeline
from loomvec.llm import langid, mixing
from loomvec.session import materialize
from tests.llm import test_linededup, test_mixing
from tests.llm.brute import jaccard_groups


def rows(df):
    return [tuple(r) for r in df.select(*pipeline.COLUMNS).collect()]


def test_each_stage_on_its_input(spark, sf_dir, tmp_path):
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        df = stage(spark, docs, sf_dir)
        if name != "pack":
            assert df.columns == pipeline.COLUMNS
        df.write.parquet(str(tmp_path / name))
        kept[name] = docs
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "language_id":
            model = langid.fit(kept[name])
            gone = {r.doc_id for r in langid.identify(kept[name], model).where("rejected").collect()}
            assert sorted(rows(docs)) == sorted(r for r in rows(kept[name]) if r[0] not in gone)
            assert len(gone) < 0.02 * kept[name].count()
        elif name == "line_dedup":
            want = {d: (t, n) for d, t, n in test_linededup.brute([(r[0], r[1]) for r in rows(kept[name])])}
            assert {r[0]: r[1] for r in rows(docs)} == {d: t for d, (t, n) in want.items() if not n or t.strip(" \t\n\x0b\x0c\r")}
            assert all(r[4] == len(r[1]) for r in rows(docs) if want[r[0]][1])
        elif name == "near_duplicates":
            stays = {d for d, _, c in jaccard_groups([(r[0], r[1]) for r in rows(kept[name])]) if d == c}
            assert sorted(rows(docs)) == sorted(r for r in rows(kept[name]) if r[0] in stays)
        elif name == "mix":
            before = rows(kept[name])
            test_mixing.check([(r[0], r[1], r[3]) for r in before], mixing.mix(kept[name]).collect(), lambda s: 2000)
            copies = {r.doc_id: r.copies for r in mixing.mix(kept[name]).collect()}
            assert Counter(r[0] for r in rows(docs)) == Counter({d: n for d, n in copies.items() if n})
            assert set(rows(docs)) <= set(before)
        else:
            pieces = docs.collect()
            assert {r.doc_id for r in pieces} == {r[0] for r in rows(kept[name])}
            lengths = Counter()
            for r in pieces:
                lengths[r.doc_id] += r.length
            n = Counter(r[0] for r in rows(kept[name]))
            assert all(lengths[r.doc_id] == n[r.doc_id] * r.doc_tokens for r in pieces)
    assert pipeline.run(spark, sf_dir).count() == docs.count()


def test_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, stage in pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.collect() == []
        docs = out if out.columns == pipeline.COLUMNS else docs


def test_nulls_and_clashing_names(spark, sf_dir):
    words = {"en": "the house of the man and the cat is here today", "de": "das haus und der hund ist nicht auf dem berg"}
    rows = [(i, f"{words[k]} {' '.join(words[k].split()[i % 5 :])} n{i}x{i}", k, "s", 0, "x", "y") for i in range(100, 160) for k in [("en", "de")[i % 2]]]
    odd = [(1, None, None, None, None, "x", "y"), (2, "", "en", "s", 0, "x", "y"), (3, words["en"], "en", None, None, "x", "y"), (3, words["en"], "en", None, None, "x", "y"), (None, f"{words['de']} und das war es", None, "s", 3, "x", "y"), (4, "12 !! 34", "en", "s", None, "x", "y")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, n_chars long, copies string, id string")
    ids = lambda df: Counter(r.doc_id for r in df.collect())
    seen = {}
    for name, stage in pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        seen[name] = ids(docs)
        if name != "pack":
            assert docs.columns == pipeline.COLUMNS
    plain = Counter({i: 1 for i in range(100, 160)})
    assert seen["language_id"] == plain + Counter({3: 2, None: 1})  # no letter, no language
    assert seen["line_dedup"] == seen["language_id"]
    assert seen["near_duplicates"][3] == 1 and seen["near_duplicates"][None] == 1 and set(seen["near_duplicates"]) <= set(seen["line_dedup"])
    assert set(seen["mix"]) <= set(seen["near_duplicates"]) and max(seen["mix"].values()) <= 2
    assert set(seen["pack"]) == set(seen["mix"])
