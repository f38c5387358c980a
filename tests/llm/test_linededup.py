import random

from loomvec.llm import linededup

SCHEMA = "doc_id long, text string, n_chars long"


def within_one(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :])


def brute(rows):
    seen, out = [], []
    for doc, text in sorted(rows):
        if text is None:
            out.append((doc, None, 0))
            continue
        kept, gone = [], 0
        for line in text.split("\n"):
            solid = bool(line.strip(" \t\x0b\x0c\r"))
            hit = solid and any(within_one(line, x) for x in seen)
            if solid:
                seen.append(line)
            if hit:
                gone += 1
            else:
                kept.append(line)
        out.append((doc, "\n".join(kept), gone))
    return out


def test_as_brute_force(spark):
    rng = random.Random(5)
    lines = ["".join(rng.choice("abcdé ñ😀") for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    rows = []
    for d in range(120):
        text = []
        for _ in range(rng.randrange(0, 8)):
            line = rng.choice(lines)
            how, at = rng.randrange(6), rng.randrange(len(line))
            if how == 0:
                line = line[:at] + "x" + line[at + 1 :]
            elif how == 1:
                line = line[:at] + line[at + 1 :]
            elif how == 2:
                line = line[:at] + rng.choice("abé") + line[at:]
            text.append(line)
        rows.append((d, "\n".join(text)))
    got = linededup.dedup_lines(spark.createDataFrame([(d, t, 0) for d, t in rows], SCHEMA))
    assert sorted((r.doc_id, r.text, r.lines_dropped) for r in got.collect()) == brute(rows)


def test_defined_cases(spark):
    long = "z" * 30_000
    rows = [(1, None), (2, ""), (3, "same line of text\n\n \t\n \t\nshort"), (3, "same line of text\n\n \t\n \t\nshort"), (4, "same line of text"), (5, long), (6, long + "y"), (None, "a line without id"), (7, "a line without id")]
    got = linededup.dedup_lines(spark.createDataFrame([(d, t, 0, "x") for d, t in rows], SCHEMA + ", mark string"))
    assert got.columns == ["doc_id", "text", "n_chars", "mark", "lines_dropped"]
    found = sorted(((r.doc_id or 0), r.text or "", r.lines_dropped) for r in got.collect())
    assert found == [(0, "a line without id", 0), (1, "", 0), (2, "", 0), (3, "same line of text\n\n \t\n \t\nshort", 0), (3, "same line of text\n\n \t\n \t\nshort", 0), (4, "", 1), (5, long, 0), (6, "", 1), (7, "", 1)]
    assert linededup.dedup_lines(spark.createDataFrame([], SCHEMA)).collect() == []


def test_clashing_names(spark):
    names = ["_gone", "_doc", "_m", "_mark", "gone", "row", "mark", "wanted", "first", "lines_dropped"]
    docs = spark.createDataFrame([(1, "one line here", *"abcdefghij"), (2, "one line here\nanother", *"abcdefghij")], "doc_id int, text string, " + ", ".join(f"{n} string" for n in names))
    got = linededup.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", *names] and dict(got.dtypes)["doc_id"] == "int"
    assert sorted((r.doc_id, r.text, r.gone, r.mark, r.lines_dropped) for r in got.collect()) == [(1, "one line here", "e", "g", 0), (2, "another", "e", "g", 1)]


def test_floors_are_parameters(spark):
    docs = spark.createDataFrame([(1, "abc\nabcd"), (2, "abc\nabcx")], "doc_id long, text string")
    assert [r.lines_dropped for r in linededup.dedup_lines(docs, min_chars=5).orderBy("doc_id").collect()] == [0, 0]
    assert [r.lines_dropped for r in linededup.dedup_lines(docs, min_near=5).orderBy("doc_id").collect()] == [0, 1]
    assert [r.lines_dropped for r in linededup.dedup_lines(docs).orderBy("doc_id").collect()] == [1, 2]
