"""Language identification with averaged hashed subword embeddings.

A text is the average of the embeddings of its byte n-grams (2 and 3, hashed
into ``BUCKETS``), followed by a linear softmax over the languages. Both
matrices are trained by stochastic gradient descent in NumPy on a bounded
sample of labelled documents, drawn by a hash of the id, whole texts:
``PER_LANGUAGE`` of each language in expectation, and ``SAMPLE`` in all, of the
``LANGUAGES`` most frequent languages at most. A tenth of the sample is held
back to fit the softmax's temperature and the rejection threshold.

As nothing but an average stands before the linear layer, the two matrices
fold into one table of logits for each bucket, and prediction is a lookup and
a sum over the whole text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0
and rejected; a null ``doc_id`` is predicted and never trained on; null
languages, and those beyond the ``LANGUAGES`` most frequent, are never
trained on; with no usable label all is ``und``; ties go
to the first language by code point; repeated rows are predicted each; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomvec.llm.textarrays import buffers, release_memory, slices

BUCKETS = 4096
DIMENSIONS = 16
#: Bounds of the labelled sample: documents of one language, of all together, and languages.
PER_LANGUAGE, SAMPLE, LANGUAGES = 800, 6400, 256
EPOCHS = 12
BATCH = 32
RATE = 0.5
#: Share of rightly classified documents that the threshold may reject.
REJECT_SHARE = 0.0005
#: A document under this score is never kept, and one above the other bound never rejected.
REJECT_MOST = 0.5
UNKNOWN = "und"

#: Lower-cases A-Z; other ASCII bytes that aren't letters become one space.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def ngram_buckets(data: np.ndarray, at: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Two rows of buckets (n = 2, 3) for every byte; ``buckets`` where there is no n-gram."""
    b = _FOLD[data].astype(np.uint32)
    n = len(b)
    out = np.full((2, n), buckets, np.int32)
    end = np.repeat(at[1:], np.diff(at))
    place = np.arange(n)
    for row, width in enumerate((2, 3)):
        m = n - width + 1
        if m <= 0:
            continue
        h = np.full(m, width, np.uint32)
        for j in range(width):
            h = (h ^ b[j : j + m]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        use = (place[:m] + width <= end[:m]) & ~((b[:m] == 32) & (b[1 : m + 1] == 32))
        out[row, :m] = np.where(use, h >> np.uint32(32 - (buckets.bit_length() - 1)), buckets)
    return out


def has_letter(data: np.ndarray) -> bool:
    if (_FOLD[data[data < 128]] != 32).any():
        return True
    return bool((data >= 128).any()) and any(c.isalpha() for c in data.tobytes().decode("utf-8", "ignore"))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    logits: np.ndarray  # (buckets + 1) x languages; the last row is zero
    temperature: float
    threshold: float

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Softmax of every row of a slice."""
        rows = len(at) - 1
        grams = ngram_buckets(data, at, len(self.logits) - 1)
        used = np.zeros(rows)
        total = np.zeros((rows, len(self.languages)))
        full = np.diff(at) > 0
        if full.any():
            starts = at[:-1][full]
            used[full] = sum(np.add.reduceat((g < len(self.logits) - 1).astype(np.int32), starts) for g in grams)
            for k in range(len(self.languages)):
                column = np.ascontiguousarray(self.logits[:, k])
                total[full, k] = sum(np.add.reduceat(column[g], starts) for g in grams)
        z = total / np.maximum(used, 1)[:, None] / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class Layers:
    """Embeddings of the buckets, and the linear layer over their average."""

    embedding: np.ndarray
    output: np.ndarray

    def fold(self) -> np.ndarray:
        """Logits of each bucket; the row behind the last is zero."""
        return np.concatenate([self.embedding @ self.output, np.zeros((1, self.output.shape[1]), np.float32)])


def train(counts: np.ndarray, labels: np.ndarray, languages: tuple[str, ...], seed: int = 9) -> Model:
    """``counts``: documents x buckets (scaled in place), ``labels``: index of each one's language."""
    return calibrated(*train_layers(counts, labels, languages, seed), languages)


def train_layers(counts: np.ndarray, labels: np.ndarray, languages: tuple[str, ...], seed: int) -> tuple[Layers, np.ndarray, np.ndarray]:
    """The layers, and averaged counts and labels of the documents that were held back."""
    rng = np.random.default_rng(seed)
    x = counts
    x /= np.maximum(x.sum(axis=1, keepdims=True), 1)
    n, classes = len(x), len(languages)
    order = rng.permutation(n)
    held = order[: n // 10] if n >= 50 else order
    fit = order[n // 10 :] if n >= 50 else order
    embed = rng.normal(0, 1 / DIMENSIONS, (x.shape[1], DIMENSIONS)).astype(np.float32)
    out = np.zeros((DIMENSIONS, classes), np.float32)
    share = np.bincount(labels[fit], minlength=classes) / len(fit)
    weight = (1 / np.maximum(share * classes, 1e-3)).astype(np.float32)
    scale = np.float32(np.sqrt(x.shape[1]))  # averages over thousands of buckets are small
    steps, step = EPOCHS * -(-len(fit) // BATCH), 0
    for _ in range(EPOCHS):
        rng.shuffle(fit)
        for start in range(0, len(fit), BATCH):
            pick = fit[start : start + BATCH]
            xb = x[pick] * scale
            hidden = xb @ embed
            z = hidden @ out
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), labels[pick]] -= 1
            p *= (weight[labels[pick]] / len(pick))[:, None]
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            grad = p @ out.T
            out -= rate * (hidden.T @ p)
            embed -= rate * (xb.T @ grad)
    return Layers(embed, out * scale), x[held], labels[held]


def calibrated(layers: Layers, held: np.ndarray, labels: np.ndarray, languages: tuple[str, ...]) -> Model:
    """Temperature and rejection threshold by the documents held back."""
    logits = layers.fold()
    z = held @ logits[:-1]

    def likelihood(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float((s[np.arange(len(held)), labels] - np.log(np.exp(s).sum(axis=1))).mean())

    temperature = max((float(t) for t in np.geomspace(0.1, 5, 40)), key=likelihood)
    s = np.exp((z - z.max(axis=1, keepdims=True)) / temperature)
    top = (s / s.sum(axis=1, keepdims=True)).max(axis=1)
    right = top[z.argmax(axis=1) == labels]
    threshold = min(REJECT_MOST, float(np.quantile(right, REJECT_SHARE))) if len(right) else REJECT_MOST
    return Model(languages, logits, temperature, threshold)


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5 is 0; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, per_language: float = PER_LANGUAGE) -> Model | None:
    """A model from the documents that aren't held out; None without a usable label."""
    usable = docs.where("text is not null and lang is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    per = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    if not per:
        return None
    per_language = min(per_language, SAMPLE / len(per))
    languages = tuple(sorted(per, key=lambda x: x.encode()))
    share = F.element_at(F.create_map(*[x for k, v in per.items() for x in (F.lit(k), F.lit(min(1.0, per_language / v)))]), F.col("lang"))
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(3)), 11) / float(1 << 53)
    sample = usable.where(draw < share).select("doc_id", "lang", "text")

    def run(batches):
        for records in batches:
            for first, last, data, at in slices(records.column(2)):
                grams = ngram_buckets(data, at)
                row = np.repeat(np.arange(last - first), np.diff(at)).astype(np.int64)
                key = np.concatenate([row[g < BUCKETS] * BUCKETS + g[g < BUCKETS] for g in grams])
                made = np.bincount(key, minlength=(last - first) * BUCKETS).astype(np.float32).reshape(last - first, BUCKETS)
                made /= np.maximum(made.sum(axis=1, keepdims=True), 1)
                packed = pa.array([x.astype(np.float16).tobytes() for x in made * 1024], pa.binary())
                yield pa.RecordBatch.from_arrays([records.column(0).slice(first, last - first), records.column(1).slice(first, last - first), packed], names=["doc_id", "lang", "counts"])

    got = sample.mapInArrow(run, "doc_id long, lang string, counts binary").toArrow()
    if not got.num_rows:
        return None
    # Rows in the order of their ids, whatever task they came from; the packed counts stay in Arrow's buffer.
    packed = buffers(got["counts"])[0].view(np.float16).reshape(-1, BUCKETS)
    lang = got["lang"].to_pylist()
    order = sorted(range(got.num_rows), key=list(zip(got["doc_id"].to_pylist(), lang, strict=True)).__getitem__)
    counts = packed[order].astype(np.float32)
    del got, packed
    names = {k: i for i, k in enumerate(languages)}
    model = train(counts, np.array([names[lang[i]] for i in order]), languages)
    del counts
    release_memory()
    return model


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with lang_pred, score and rejected for every whole text."""
    model = fit(docs) if model is None else model
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    docs = docs.select(*names)
    where = names.index("text")
    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches):
        for records in batches:
            label: list[str] = []
            score = np.zeros(records.num_rows)
            for first, last, data, at in slices(records.column(where)):
                if model is None:
                    label += [UNKNOWN] * (last - first)
                    continue
                p = model.scores(data, at)
                best = p.argmax(axis=1)
                for r in range(last - first):
                    known = has_letter(data[at[r] : at[r + 1]])
                    label.append(model.languages[best[r]] if known else UNKNOWN)
                    score[first + r] = p[r, best[r]] if known else 0.0
            refused = [x == UNKNOWN or s < model.threshold for x, s in zip(label, score.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*records.columns, pa.array(label, pa.string()), pa.array(score), pa.array(refused, pa.bool_())], names=schema.names)

    return docs.mapInArrow(run, schema)
