"""Toxicity by a learned lexicon, fuzzy matching and context.

A lexicon of terms and stems is learned from labelled documents, and put into
a trie. A word is looked up by intersecting the Levenshtein automaton of each
term (its rows carried down the trie) with the trie: a term matches the whole
word, a stem a beginning of it, at up to one edit if the entry is long enough
and such near words are not part of clean text. Every word of the whole text
is looked up; hashes of the word's beginnings with at most one letter left out
rule nearly all words out beforehand, without a false dismissal.

A match counts fully, a fuzzy one less, and either less again inside quotation
marks or beside a word of reporting, which separates quotation from abuse. The
sum goes through a logistic curve that is fitted on the labelled sample.

Learning uses a bounded sample of the labelled documents (``POSITIVE`` and
``NEGATIVE`` of them in expectation, drawn by a hash of the id, whole texts)
and nothing but their texts and labels.

Defined cases: null and empty texts get the score of a text without matches;
with no usable labels of both kinds the lexicon is empty and all scores are 0;
labels that contradict each other count as toxic; a null ``doc_id`` is scored
and never learned from; repeated rows are scored each; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomvec.llm.textarrays import PolyHash, mix64, release_memory, slices
from loomvec.session import materialize

POSITIVE, NEGATIVE = 1500, 4500
STEM_MIN = 4
FUZZY_MIN = 5
#: Positive documents of the sample that an entry must match, beyond what the ones before it cover; this bounds the lexicon.
LEAST_NEW = 3
FUZZY_WEIGHT, QUOTED_WEIGHT = 0.6, 0.25
WINDOW = 40
THRESHOLD = 0.3
QUOTES = "\"“”„«»‹›"
#: Words that introduce what others said (fixed values, four languages).
REPORTING = ("said", "says", "wrote", "writes", "called", "quote", "quoted", "according", "sagte", "schrieb", "zitat", "zitiert", "nannte", "dit", "disait", "écrit", "citation", "appelé", "dijo", "escribió", "cita", "llamó")


def _fold(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _word_mask(points: np.ndarray) -> np.ndarray:
    """Letters, digits, and the signs that stand for letters in disguised words."""
    low = np.zeros(128, bool)
    for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789@$*":
        low[ord(c)] = True
    out = points >= 0xC0
    out &= ~((points >= 0x2000) & (points <= 0x206F)) & (points != 0x3000)
    small = points < 128
    out[small] = low[points[small]]
    return out


def tokens(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words of a slice of folded code points."""
    if not len(points):
        return (np.zeros(0, np.int64),) * 3
    inside = _word_mask(points)
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = at[1:-1]
    edge = edge[(edge > 0) & (edge < len(points))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(at, start, side="right") - 1


@dataclass
class _Node:
    children: dict[str, _Node] = field(default_factory=dict)
    entry: int = -1


@dataclass(frozen=True)
class Entry:
    text: str
    stem: bool
    fuzzy: bool


class Matcher:
    """Trie of the entries, and the automaton walk over it."""

    def __init__(self, entries: list[Entry], benign: frozenset[str] = frozenset()):
        self.entries, self.benign, self.root = entries, benign, _Node()
        for i, e in enumerate(entries):
            node = self.root
            for c in e.text:
                node = node.children.setdefault(c, _Node())
            node.entry = i
        self.hasher = PolyHash(41)
        self.lengths = sorted({n for e in entries for n in ((len(e.text) - 1, len(e.text), len(e.text) + 1) if e.fuzzy else (len(e.text),))})
        self.table = np.zeros(1 << 20, bool)
        for e in entries:
            for rest in {e.text, *(e.text[:i] + e.text[i + 1 :] for i in range(len(e.text) * e.fuzzy))}:
                points = np.array([ord(c) for c in rest], np.uint32)
                sums = self.hasher.sums(points)
                self.table[int(mix64(self.hasher.raw(sums, np.array([0]), np.array([len(rest)])))[0] >> np.uint64(44))] = True
        self.fuzzy_lengths = {n for e in entries if e.fuzzy for n in (len(e.text) - 1, len(e.text), len(e.text) + 1)}
        self.known: dict[str, tuple[int, int] | None] = {}

    def candidates(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which words may match, by hashes of their beginnings with at most one letter left out."""
        out = np.zeros(len(start), bool)
        sums = self.hasher.sums(points)
        size = end - start
        for n in self.lengths:
            long = np.flatnonzero(size >= n)
            s = start[long]
            hit = self.table[(mix64(self.hasher.raw(sums, s, s + n)) >> np.uint64(44)).astype(np.int64)]
            if n in self.fuzzy_lengths:
                for i in range(n):
                    value = self.hasher.raw(sums, s, s + i) + self.hasher.raw(sums, s + i + 1, s + n) * self.hasher.powers[i]
                    hit |= self.table[(mix64(value) >> np.uint64(44)).astype(np.int64)]
            out[long[hit]] = True
        return out

    def match(self, word: str) -> tuple[int, int] | None:
        """(entry, edits) of the best match of a word: fewest edits, then longest entry."""
        if word in self.known:
            return self.known[word]
        best: tuple[int, int, int] | None = None
        n = len(word)
        stack = [(self.root, list(range(n + 1)))]
        while stack:
            node, row = stack.pop()
            if node.entry >= 0:
                e = self.entries[node.entry]
                edits = min(row) if e.stem else row[n]
                if edits <= (1 if e.fuzzy and word not in self.benign else 0):
                    best = min(best or (9, 0, 0), (edits, -len(e.text), node.entry))
            for c, child in node.children.items():
                below = [row[0] + 1]
                for j in range(1, n + 1):
                    below.append(min(below[-1] + 1, row[j] + 1, row[j - 1] + (word[j - 1] != c)))
                if min(below) <= 1:
                    stack.append((child, below))
        found = (best[2], best[0]) if best else None
        if len(self.known) < 200_000:
            self.known[word] = found
        return found


_QUOTE_POINTS = np.array(sorted(ord(c) for c in QUOTES), np.uint32)


def quoted(text: str, points: np.ndarray, at: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which words stand inside quotation marks on their line, or with a word of reporting close before them.

    The marks and line ends of the slice are listed once, so the cost doesn't
    grow with the length of a line.
    """
    marks, breaks = np.flatnonzero(np.isin(points, _QUOTE_POINTS)), np.flatnonzero(points == 10)
    after = np.searchsorted(breaks, start)
    line = np.maximum(at[row], np.append(breaks, -1)[after - 1] + 1 if len(breaks) else 0)
    line = np.where(after > 0, line, at[row])
    stop = np.minimum(at[row + 1], np.append(breaks, len(points))[after])
    opened = (np.searchsorted(marks, start) - np.searchsorted(marks, line)) % 2 == 1
    inside = opened & (np.searchsorted(marks, stop) > np.searchsorted(marks, end))
    for i in np.flatnonzero(~inside):
        near = text[max(line[i], start[i] - WINDOW) : start[i]].split()
        inside[i] = any(w.strip(".,:;!?()'") in REPORTING for w in near)
    return inside


def weights(matcher: Matcher, column: pa.Array) -> np.ndarray:
    """Weighted sum of the matches of every text."""
    out = np.zeros(len(column))
    if not matcher.entries:
        return out
    for first, last, data, at in slices(column):
        text = _fold(data.tobytes().decode("utf-8"))
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])[at]
        start, end, row = tokens(points, at)
        hits = np.flatnonzero(matcher.candidates(points, start, end))
        found = [matcher.match(text[start[i] : end[i]]) for i in hits]
        hits = hits[np.array([f is not None for f in found], bool)]
        weight = np.array([FUZZY_WEIGHT if f[1] else 1.0 for f in found if f is not None])
        if len(hits):
            weight = np.where(quoted(text, points, at, row[hits], start[hits], end[hits]), weight * QUOTED_WEIGHT, weight)
            np.add.at(out, first + row[hits], weight)
    return out


@dataclass(frozen=True)
class Model:
    entries: list[Entry]
    benign: frozenset[str]
    bias: float
    slope: float

    def score(self, weight: np.ndarray) -> np.ndarray:
        if not self.entries:
            return np.zeros(len(weight))
        return 1 / (1 + np.exp(-(self.bias + self.slope * np.log1p(weight))))


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4 is 2; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _words_of(texts: DataFrame) -> list[frozenset[str]]:
    """Distinct words of each of a bounded number of texts."""

    def run(batches):
        for records in batches:
            made = []
            for text in records.column(0):
                folded = _fold(text.as_py())
                points = np.frombuffer(folded.encode("utf-32-le"), np.uint32)
                start, end, _ = tokens(points, np.array([0, len(points)]))
                made.append(sorted({folded[a:b] for a, b in zip(start, end, strict=True) if b - a >= STEM_MIN}))
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.string()))], names=["words"])

    got = texts.select("text").mapInArrow(run, "words array<string>").toArrow()
    return [frozenset(x) for x in got["words"].to_pylist()]


def _frequencies(texts: DataFrame, wanted: list[tuple[str, bool]]) -> np.ndarray:
    """In how many texts each of the wanted (word, stem) occurs."""
    where = {w: i for i, w in enumerate(wanted)}

    def run(batches):
        total = np.zeros(len(where), np.int64)
        for records in batches:
            for text in records.column(0):
                folded = _fold(text.as_py())
                points = np.frombuffer(folded.encode("utf-32-le"), np.uint32)
                start, end, _ = tokens(points, np.array([0, len(points)]))
                seen = set()
                for w in {folded[a:b] for a, b in zip(start, end, strict=True) if b - a >= STEM_MIN}:
                    seen.add(where.get((w, False), -1))
                    seen.update(where.get((w[:n], True), -1) for n in range(STEM_MIN, len(w)))
                seen.discard(-1)
                total[list(seen)] += 1
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    got = texts.select("text").mapInArrow(run, "total binary").toArrow()["total"].to_pylist()
    return np.sum([np.frombuffer(x, np.int64) for x in got], axis=0) if got else np.zeros(len(wanted), np.int64)


def _near_words(texts: DataFrame, entries: list[Entry]) -> Counter:
    """Words of the texts that only match by an edit, with their numbers of texts."""

    def run(batches):
        matcher = Matcher(entries)
        for records in batches:
            found: list[str] = []
            for first, last, data, at in slices(records.column(0)):
                text = _fold(data.tobytes().decode("utf-8"))
                points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                at = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])[at]
                start, end, row = tokens(points, at)
                hits = {(int(row[i]), text[start[i] : end[i]]) for i in np.flatnonzero(matcher.candidates(points, start, end))}
                found += sorted(w for _, w in hits if (m := matcher.match(w)) and m[1])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["word"])

    got = texts.select("text").mapInArrow(run, "word string").groupBy("word").count().toArrow()
    return Counter(dict(zip(got["word"].to_pylist(), got["count"].to_pylist(), strict=True)))


def _cover(positive: list[frozenset[str]], negatives: DataFrame, n_negative: int) -> list[Entry]:
    """Terms and stems that mark positive texts, each for texts that the ones before leave short of two."""
    positive = sorted(set(positive), key=sorted)  # copies count once
    held: dict[tuple[str, bool], set[int]] = {}
    for i, found in enumerate(positive):
        for w in found:
            held.setdefault((w, False), set()).add(i)
            for n in range(STEM_MIN, len(w)):
                held.setdefault((w[:n], True), set()).add(i)
    least = max(LEAST_NEW, len(positive) // 200)
    wanted = sorted(k for k, v in held.items() if len(v) >= least)
    counts = _frequencies(negatives, wanted)
    good = {k: held[k] for k, c in zip(wanted, counts, strict=True) if c <= max(1, 0.0005 * n_negative) and len(held[k]) / max(1, len(positive)) > 40 * c / max(1, n_negative)}
    need = {i: 2 for i in range(len(positive))}
    out: list[Entry] = []
    while good:
        gain = {k: sum(need[i] > 0 for i in v) for k, v in good.items()}
        best = max(good, key=lambda k: (gain[k], len(k[0]), not k[1], k[0]))
        if gain[best] < least:
            break
        for i in good.pop(best):
            need[i] -= 1
        text, stem = best
        # What the entry covers is spent: longer stems and words under a stem, the stems of a term.
        good = {k: v for k, v in good.items() if not (stem and k[0].startswith(text)) and not (k[1] and text.startswith(k[0]))}
        out.append(Entry(text, stem, len(text) >= FUZZY_MIN))
    return out


def fit(docs: DataFrame, labels: DataFrame, positive: int = POSITIVE, negative: int = NEGATIVE) -> Model:
    """Lexicon and curve from the labelled documents that aren't held out."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    per = {bool(r["marked"]): r["count"] for r in known.groupBy((F.col("toxic") > 0).alias("marked")).count().collect()}
    empty = Model([], frozenset(), 0.0, 0.0)
    if len(per) < 2:
        return empty
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(5)), 11) / float(1 << 53)
    share = F.when(F.col("toxic") > 0, F.lit(min(1.0, positive / per[True]))).otherwise(F.lit(min(1.0, negative / per[False])))
    chosen = known.where(draw < share)  # about positive + negative rows, so that it can be broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(2)) == 0).alias("half"))
    texts = materialize(texts, "labelled")
    marked, clean = texts.where("toxic > 0"), texts.where("toxic <= 0")
    n_clean = clean.count()
    entries = _cover(_words_of(marked), clean, n_clean)
    if not entries or not n_clean:
        return empty
    # Fuzzy matching is kept for entries whose near words, once those of one half are known, hardly occur in the other.
    seen, other = _near_words(clean.where("half"), entries), _near_words(clean.where("not half"), entries)
    judge = Matcher(entries)
    strange = Counter()
    for w, n in other.items():
        if w not in seen:
            strange[judge.match(w)[0]] += n
    entries = [Entry(e.text, e.stem, e.fuzzy and strange[i] <= 0.0005 * n_clean) for i, e in enumerate(entries)]
    benign = frozenset(seen) | frozenset(other)
    model = Model(entries, benign, 0.0, 0.0)
    got = _weighed(texts.select("toxic", "text"), model, "toxic int").toArrow()
    x, y = np.log1p(np.array(got["weight"].to_pylist())), np.array(got["toxic"].to_pylist(), float) > 0
    bias, slope = _logistic(x, y)
    release_memory()
    return Model(entries, benign, bias, slope)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton's steps for a curve with one input, both classes weighing the same, held in by a small penalty."""
    w = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum()))
    theta = np.zeros(2)
    features = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ theta, -30, 30)))
        grad = features.T @ (w * (p - y)) + 1e-3 * theta
        hess = (features * (w * p * (1 - p))[:, None]).T @ features + 1e-3 * np.eye(2)
        theta = theta - np.linalg.solve(hess, grad)
    return float(theta[0]), float(theta[1])


def _weighed(df: DataFrame, model: Model, first: str) -> DataFrame:
    """(first column, weight) for rows (first column, text)."""
    name = first.split()[0]

    def run(batches):
        matcher = Matcher(model.entries, model.benign)
        for records in batches:
            yield pa.RecordBatch.from_arrays([records.column(0), pa.array(weights(matcher, records.column(1)))], names=[name, "weight"])

    return df.mapInArrow(run, f"{first}, weight double")


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted for every whole text."""

    def run(batches):
        matcher = Matcher(model.entries, model.benign)
        for records in batches:
            score = model.score(weights(matcher, records.column(1)))
            yield pa.RecordBatch.from_arrays([records.column(0), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
