import numpy as np
import pytest
from pyspark.sql import functions as F

from loomvec.llm import langid, queries, toxicity


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = queries.op6_language_id(spark, sf).join(truth, "doc_id").where("held_out")
    r = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("right"), F.avg(F.col("rejected").cast("double")).alias("rejected"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    assert r.right > 0.97 and r.rejected < 0.01 and 0 <= r.low <= r.high <= 1


def test_language_defined_cases(spark):
    words = {"en": "the cat and the house of this", "de": "der hund und die katze ist nicht", "fr": "le chat et la maison dans une"}
    rows = [(i, " ".join(np.random.default_rng(i).permutation(words[k].split() * 6)), k, k) for i in range(120) for k in [list(words)[i % 3]]]
    docs = spark.createDataFrame([*rows, (500, "the cat", None, "x"), (None, "der hund und", "de", "x")], "doc_id long, text string, lang string, lang_pred string")
    model = langid.fit(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !! 34"), (4, "der hund und die katze"), (4, "der hund und die katze"), (5, "日本"), (6, "the cat and " * 20_000)], "doc_id long, text string")
    got = sorted((r.doc_id, r.lang_pred) for r in langid.identify(odd, model).collect())
    assert got[:3] == [(1, "und"), (2, "und"), (3, "und")] and got[3] == got[4] == (4, "de") and got[5][1] in words and got[6] == (6, "en")
    assert all(r.rejected and r.score == 0.0 for r in langid.identify(odd, model).where("doc_id < 4").collect())
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.fit(none) is None and langid.identify(none).collect() == []


def plain_grams(text):
    """Buckets of the byte n-grams, one at a time."""
    folded = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text.encode())
    for n in (2, 3):
        for i in range(len(folded) - n + 1):
            if folded[i : i + 2] != b"  ":
                h = n
                for c in folded[i : i + n]:
                    h = (h ^ c) * 0x01000193 & 0xFFFFFFFF
                yield ((h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF) >> 20


def test_scores_as_embedding_average_and_softmax():
    rng = np.random.default_rng(2)
    words = [["the", "and", "of", "cat"], ["der", "und", "hünd", "katze"], ["le", "été", "chat", "une"]]
    texts = [" ".join(rng.choice(words[i % 3], 12)) for i in range(90)]
    counts = np.zeros((90, langid.BUCKETS), np.float32)
    for row, text in zip(counts, texts, strict=True):
        for g in plain_grams(text):
            row[g] += 1
    layers, held, labels = langid.train_layers(counts, np.arange(90) % 3, ("de", "en", "fr"), 9)
    model = langid.calibrated(layers, held, labels, ("de", "en", "fr"))
    asked = [*texts[:9], "The CAT, 12 and!! of\n\nhim", "ü", "a"]
    raw = [t.encode() for t in asked]
    got = model.scores(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for text, p in zip(asked, got, strict=True):
        grams = list(plain_grams(text))
        average = np.mean([layers.embedding[g] for g in grams], axis=0) if grams else np.zeros(langid.DIMENSIONS)
        z = np.exp((average @ layers.output) / model.temperature - np.max((average @ layers.output) / model.temperature))
        assert p == pytest.approx(z / z.sum(), abs=1e-5)


def test_language_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, f"some words of text number {i}", f"l{i % 300}") for i in range(1200)], "doc_id int, text string, lang string")
    model = langid.fit(docs, per_language=3)
    assert len(model.languages) <= langid.LANGUAGES


def test_ngrams_stay_in_their_text():
    one = np.frombuffer(b"abc", np.uint8)
    both = np.frombuffer(b"abcxabc", np.uint8)
    a = langid.ngram_buckets(one, np.array([0, 3]))
    b = langid.ngram_buckets(both, np.array([0, 3, 4, 7]))
    assert (b[:, :3] == a).all() and (b[:, 4:] == a).all() and (b[:, 3] == langid.BUCKETS).all()


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i, *row[1:]], row
        for j, y in enumerate(b, 1):
            row[j] = min(row[j - 1] + 1, last[j] + 1, last[j - 1] + (x != y))
    return row[-1]


def test_automaton_as_brute_force():
    entries = [toxicity.Entry("idiot", False, True), toxicity.Entry("scum", False, False), toxicity.Entry("lowei", True, True)]
    matcher = toxicity.Matcher(entries)
    rng = np.random.default_rng(3)
    words = {"idiot", "idiots", "idot", "1diot", "scum", "scun", "loweixyz", "lovweixyz", "loeixyz", "oweiabc", "lowe", "xx"}
    for w in [*words]:
        for _ in range(40):
            at, how = rng.integers(0, len(w) + 1), rng.integers(0, 3)
            words.add(w[:at] + ("x" if how else "") + w[at + (how == 1) :])
    for w in sorted(words):
        best = min((0 if d == 0 else 1 for e in entries for d in [min(levenshtein(e.text, w[:n]) for n in range(len(w) + 1)) if e.stem else levenshtein(e.text, w)] if d <= (1 if e.fuzzy else 0)), default=None)
        found = matcher.match(w)
        assert (found[1] if found else None) == best, w
        points = np.array([ord(c) for c in w], np.uint32)
        if found and len(w):
            assert matcher.candidates(points, np.array([0]), np.array([len(w)]))[0], w


def test_quotation_counts_less():
    import pyarrow as pa

    matcher = toxicity.Matcher([toxicity.Entry("idiot", False, True)])
    got = toxicity.weights(matcher, pa.array(["you idiot", "he said idiot", 'a "idiot" b', "you idyot", None, "", "x\nidiot"]))
    assert got.tolist() == [1.0, 0.25, 0.25, 0.6, 0.0, 0.0, 1.0]


def plain_weight(entries, text):
    """The weighted sum of a text's matches, word by word."""
    low, total, i = text.lower(), 0.0, 0
    signs = "abcdefghijklmnopqrstuvwxyz0123456789@$*"
    while i < len(low):
        j = i
        while j < len(low) and (low[j] in signs or (low[j] >= "\u00c0" and not "\u2000" <= low[j] <= "\u206f" and low[j] != "\u3000")):
            j += 1
        if j > i:
            word = low[i:j]
            edits = [min(levenshtein(e.text, word[:n]) for n in range(len(word) + 1)) if e.stem else levenshtein(e.text, word) for e in entries]
            best = min((d for e, d in zip(entries, edits, strict=True) if d <= e.fuzzy), default=None)
            if best is not None:
                a, b = low.rfind("\n", 0, i) + 1, low.find("\n", j)
                before, after = low[a:i], low[j : b if b >= 0 else len(low)]
                said = any(w.strip(".,:;!?()'") in toxicity.REPORTING for w in low[max(a, i - toxicity.WINDOW) : i].split())
                inside = sum(before.count(q) for q in toxicity.QUOTES) % 2 == 1 and any(q in after for q in toxicity.QUOTES)
                total += (toxicity.FUZZY_WEIGHT if best else 1.0) * (toxicity.QUOTED_WEIGHT if said or inside else 1.0)
        i = max(j, i + 1)
    return total


def test_weights_and_score_as_plain_version():
    import pyarrow as pa

    entries = [toxicity.Entry("idiot", False, True), toxicity.Entry("scum", False, False), toxicity.Entry("lowei", True, True)]
    rng = np.random.default_rng(5)
    parts = ["idiot", "idyot", "SCUM", "scun", "loweixx", "said", '"', "“", "”", "\n", "x", "word,", "é", "zitat:", "lo\nwei"]
    texts = [" ".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(300)] + [None, ""]
    got = toxicity.weights(toxicity.Matcher(entries), pa.array(texts))
    assert got.tolist() == pytest.approx([plain_weight(entries, t or "") for t in texts])
    model = toxicity.Model(entries, frozenset(), -2.0, 3.0)
    assert model.score(got).tolist() == pytest.approx([1 / (1 + np.exp(2.0 - 3.0 * np.log(1 + w))) for w in got])


def test_long_line_takes_time_in_proportion():
    import time

    import pyarrow as pa

    matcher = toxicity.Matcher([toxicity.Entry("idiot", False, True)])
    seconds = []
    for n in (20_000, 80_000):
        column = pa.array(['"x" you idiot ' * n])
        began = time.process_time()
        assert toxicity.weights(matcher, column)[0] > 0
        seconds.append(time.process_time() - began)
    assert seconds[1] < 9 * seconds[0] + 0.5


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op7_toxicity(spark, sf).join(labels, "doc_id").where("held_out")
    r = got.agg(F.count_if((F.col("toxic") == 1) & (F.col("predicted") == 1)).alias("tp"), F.count_if((F.col("toxic") == 0) & (F.col("predicted") == 1)).alias("fp"), F.count_if((F.col("toxic") == 1) & (F.col("predicted") == 0)).alias("fn")).first()
    assert r.tp / (r.tp + r.fn) > 0.9 and r.tp / (r.tp + r.fp) > 0.9


def test_toxicity_defined_cases(spark):
    docs = spark.createDataFrame([(i, f"bad idiot loser here{i}" if i % 3 == 0 else f"fine words number {i % 7}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(0, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    odd = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, "idiot loser " * 9000, 1.0), (3, "idiot loser " * 9000, 1.0), (None, "idiot loser", 1.0)], "doc_id long, text string, score double")
    got = sorted((r.doc_id or 0, r.predicted) for r in toxicity.toxicity(odd, model).collect())
    assert got == [(0, 1), (1, 0), (2, 0), (3, 1), (3, 1)]
    marked = toxicity.fit(docs.withColumn("doc_id", F.col("doc_id").cast("int")), labels.withColumn("toxic", F.col("toxic") > 0))
    assert marked.entries == model.entries and marked.slope == pytest.approx(model.slope)
    none = toxicity.fit(docs, labels.where("toxic = 0"))
    assert {r.score for r in toxicity.toxicity(docs, none).collect()} == {0.0}
    assert toxicity.toxicity(docs.where("false"), model).collect() == []
