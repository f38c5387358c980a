"""N-gram Jaccard join with PartEnum signatures.

A document's set holds its distinct shingles of five words. Sets are put into
size bands such that partners lie in one band or in the next. For one
instance (smaller set in band i) two partners differ in at most k shingles.
The feature domain is dealt into first-level partitions, more than
k / (K2 + 1) of them, so partners differ in at most K2 features in one at
least. Each of these is dealt into N2 second-level partitions, and each subset
of N2 - K2 of them gives a signature, a hash of what the set holds there:
partners agree in one subset at least.

Exactness. A subset may be empty, and a signature may be shared by very many
documents (a common passage). Partners share signatures of as many first-level
partitions as a set has in use beyond those that k differences can spoil, so a
set need not be looked at under its most common ones (``needed``, used before
very large groups are dealt out again). A set with too few partitions in use
also signs with each shingle alone, so two such sets meet there. No pair is
lost, whatever the skew.

Cost. Equal sets are merged first, so copies never meet. Signatures travel as
packed arrays, one row for each of many parts, and meet in one task by part;
within a batch, members of a common signature beyond a few are linked to the
batch's first and not sent. A group of up to ``SMALL`` members gives all its
pairs; a larger one gives pairs with its smallest member only (a star). The
pairs are ruled out by small sketches, with certainty, or verified on the sets,
and linked sets are merged into components. Groups that still span several
components are compared within the group, in blocks, by sketches; only pairs
that aren't ruled out leave the block. A group in which that would be more
than ``MOST_PAIRS`` comparisons is dealt out again first: its members sign with
fresh partitions, each signature together with the group's, which splits those
that share no more than a passage, and the new groups go the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomvec.llm.components import connected_components
from loomvec.llm.textarrays import LOWER, PolyHash, buffers, mix64, slices, steady_memory, words
from loomvec.session import materialize, small_batches

WORDS = 5
#: Jaccard of at least SHARED / ALL.
SHARED, ALL = 80, 100
#: Members of a group that gives all pairs; pairs of a larger one that are compared in blocks at once.
SMALL, MOST_PAIRS = 4, 1 << 21
#: Times that groups beyond that are dealt out again; what is larger still is compared in blocks all the same.
LEVELS = 2
#: Signatures of a batch that are sorted and sent together.
FLUSH = 1 << 18
#: Packed rows, or texts, of an Arrow batch where signatures are made and meet.
PARCELS = 64
#: Ids, and bytes of arrays, that are broadcast at most; beyond that a shuffle join is used.
BROADCAST_IDS, BROADCAST_BYTES = 1 << 21, 32 << 20
SEED = 11
#: Pairs that are compared at once, without waiting for links that make some needless.
DIRECT = 1 << 18
#: First-level partitions for each that is needed.
SPREAD = 1.2
#: Second-level partitions, and how many of them a signature leaves out.
N2, K2 = 3, 1
KEPT = [list(x) for x in combinations(range(N2), N2 - K2)]
#: A signature holds its parity and, above, its first-level partition in so many bits.
TAG_BITS = 13
TAGS = (1 << TAG_BITS) - 1


@lru_cache
def _hasher() -> PolyHash:
    return PolyHash(5)


def shingle_sets(column: pa.Array, n: int = WORDS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, sorted distinct hashes, offsets) over a text column."""
    hasher = _hasher()
    factors = mix64(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    for first, last, data, at in slices(column):
        rows = last - first
        data = LOWER[data]
        start, end, row = words(data, at)
        value = hasher.spans(hasher.sums(data), start, end)
        count = np.bincount(row, minlength=rows)
        begins = np.concatenate([[0], np.cumsum(count)])
        # A shingle starts at each word that has n - 1 after it in its row, or at the first of a short row.
        index = np.arange(len(row)) - begins[row]
        heads = np.flatnonzero((index + n <= count[row]) | ((index == 0) & (count[row] < n)))
        made = np.full(len(heads), np.uint64(0))
        width = np.minimum(count[row[heads]], n)
        for j in range(n):
            has = width > j
            made[has] += value[heads[has] + j] * factors[j]
        made = mix64(made + width.astype(np.uint64))
        owner = row[heads]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))])
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a > 1:
                made[a:b].sort()
        fresh = np.ones(len(made), bool)
        fresh[1:] = (made[1:] != made[:-1]) | (owner[1:] != owner[:-1])
        sizes = np.bincount(owner[fresh], minlength=rows)
        yield first, last, made[fresh], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


@lru_cache
def band_tops(limit: int = 1 << 40) -> np.ndarray:
    """Largest size of each band: a set's partners are in its band and the next."""
    tops = [1]
    while tops[-1] < limit:
        tops.append(max(tops[-1] + 1, tops[-1] * ALL // SHARED))
    return np.array(tops, np.int64)


def most_differences(top: np.ndarray) -> np.ndarray:
    """Partners whose smaller set has ``top`` shingles differ in so many at most."""
    return top * (ALL - SHARED) // SHARED


def _instances(sizes: np.ndarray, side: int) -> np.ndarray:
    """Band of the smaller partner: the set's own (side 0) or the one before (side 1); -1: none."""
    tops = band_tops()
    band = np.searchsorted(tops, sizes, side="left") - side
    band[(band < 0) | (sizes == 0)] = -1
    # Sets that allow no difference are equal, and those are merged already.
    band[(band >= 0) & (most_differences(tops[np.maximum(band, 0)]) == 0)] = -1
    return band


def first_level(band: np.ndarray, spread: float) -> tuple[np.ndarray, np.ndarray]:
    """How many first-level partitions are needed, and how many there are, for each row's instance (0: none)."""
    need = most_differences(band_tops()[np.maximum(band, 0)]) // (K2 + 1) + 1
    return need, np.where(band >= 0, np.ceil(need * spread).astype(np.int64), 0)


def signatures(hashes: np.ndarray, at: np.ndarray, band: np.ndarray, seed: int, spread: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, row) of the subsets that aren't empty, and how many first-level partitions each row has to spare.

    The lowest bit of a signature is the instance's parity, those above it
    name the first-level partition. To spare: partitions none of whose subsets
    is empty, less those needed; below 0 the row has too few. Without
    ``spread`` each shingle is a signature.
    """
    rows = len(at) - 1
    sizes = np.diff(at)
    live = band >= 0
    owner = np.repeat(np.arange(rows), sizes)
    keep = live[owner]
    owner, h = owner[keep], hashes[keep]
    salt = mix64(band.astype(np.uint64) * np.uint64(2654435761) + np.uint64(seed))
    drawn = mix64(h ^ salt[owner])
    parity = (band & 1).astype(np.uint64)
    if spread is None:
        return (drawn & ~np.uint64(1)) | parity[owner], owner, np.zeros(rows, np.int64)
    need, n = first_level(band, spread)
    first = np.concatenate([[0], np.cumsum(n)])
    cell = first[owner] * N2 + ((drawn >> np.uint64(32)) * (n[owner] * N2).astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    body = mix64(drawn + np.uint64(0x51ED270B))
    low, high = (np.bincount(cell, weights=x.astype(np.float64), minlength=first[-1] * N2).reshape(-1, N2) for x in (body & np.uint64(0xFFFFFFFF), body >> np.uint64(32)))
    row = np.repeat(np.arange(rows), n)
    spare = np.where(live, np.bincount(row[((low + high) > 0).sum(axis=1) > K2], minlength=rows) - need, 0)
    tag = (np.arange(len(row)) - first[row]).astype(np.uint64) & np.uint64(TAGS)
    made, of = [], []
    for kept in KEPT:
        l, h = low[:, kept].sum(axis=1), high[:, kept].sum(axis=1)
        used = np.flatnonzero(l + h > 0)
        sig = mix64(l[used].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix64(h[used].astype(np.uint64) + salt[row[used]]))
        made.append((sig & ~np.uint64(2 * TAGS + 1)) | tag[used] << np.uint64(1) | parity[row[used]])
        of.append(row[used])
    return np.concatenate(made), np.concatenate(of), spare


def groups(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of a sorted array."""
    starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(sig)))


def split_groups(sig: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of the small groups, and (signature, smallest, member) of the larger ones.

    Takes rows sorted by signature and id, without repetitions.
    """
    starts, lengths = groups(sig)
    a, b = [], []
    for n in range(2, SMALL + 1):
        at = starts[lengths == n]
        for i in range(n):
            for j in range(i + 1, n):
                a.append(ids[at + i])
                b.append(ids[at + j])
    big = lengths > SMALL
    at, n = starts[big], lengths[big]
    member = np.repeat(at - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(at) else np.zeros(0, np.int64)
    leader = np.repeat(at, n)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b]), sig[member], ids[leader], ids[member]


def _in_order(sig: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(sig, kind="stable")
    sig, ids = sig[order], ids[order]
    # Ids within equal signatures: only where a run exists.
    same = np.flatnonzero(sig[1:] == sig[:-1])
    if len(same):
        touched = np.unique(np.concatenate([same, same + 1]))
        inner = np.lexsort((ids[touched], sig[touched]))
        ids[touched] = ids[touched][inner]
        keep = np.ones(len(sig), bool)
        keep[1:] = (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])
        sig, ids = sig[keep], ids[keep]
    return sig, ids


PAIR, STAR = 0, 1
FOUND = "kind int, a long, b long, sig long"


def _found(kind: int, a: np.ndarray, b: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(sig.astype(np.uint64).view(np.int64))], names=["kind", "a", "b", "sig"])


def _send(docs: DataFrame, parts: int, spread: float) -> DataFrame:
    """Packed signatures by part. ``docs``: doc_id, text."""
    shift = np.uint64(64 - (parts.bit_length() - 1))

    def run(batches):
        sigs: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0

        def flush():
            nonlocal held
            sig, doc = _in_order(np.concatenate([np.zeros(0, np.uint64), *sigs]), np.concatenate([np.zeros(0, np.int64), *ids]))
            starts, lengths = groups(sig)
            stars = np.zeros((3, 0), np.int64)
            if len(lengths) and lengths.max() > 8 * SMALL:  # a common signature: what exceeds a few stays here as a star
                rank = np.arange(len(sig)) - np.repeat(starts, lengths)
                extra = rank > SMALL
                extra &= np.repeat(lengths, lengths) > 8 * SMALL
                stars = np.stack([sig[extra].view(np.int64), doc[np.repeat(starts, lengths)[extra]], doc[extra]])
                sig, doc = sig[~extra], doc[~extra]
            edges = np.searchsorted(sig >> shift, np.arange(parts + 1, dtype=np.uint64)) if parts > 1 else np.array([0, len(sig)])
            star_part = stars[0].view(np.uint64) >> shift if parts > 1 else np.zeros(stars.shape[1], np.uint64)
            rows: list[tuple[int, bytes]] = []
            star_edges = np.searchsorted(star_part, np.arange(parts + 1, dtype=np.uint64))
            for p in range(parts):
                lo, hi, s0, s1 = edges[p], edges[p + 1], star_edges[p], star_edges[p + 1]
                if hi > lo or s1 > s0:
                    rows.append((p, b"".join([np.array([hi - lo, s1 - s0], np.int64).tobytes(), sig[lo:hi].tobytes(), doc[lo:hi].tobytes(), stars[:, s0:s1].tobytes()])))
            held = 0
            sigs.clear()
            ids.clear()
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["part", "packed"])

        for records in batches:
            doc = records.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, last, hashes, at in shingle_sets(records.column(1)):
                sizes = np.diff(at)
                for side in (0, 1):
                    band = _instances(sizes, side)
                    sig, row, spare = signatures(hashes, at, band, SEED, spread)
                    sigs.append(sig)
                    ids.append(doc[first:last][row])
                    held += len(sig)
                    if (spare < 0).any():
                        sig, row, _ = signatures(hashes, at, np.where(spare < 0, band, -1), SEED + 100, None)
                        sigs.append(sig)
                        ids.append(doc[first:last][row])
                        held += len(sig)
                if held >= FLUSH:
                    yield flush()
        yield flush()

    return docs.mapInArrow(run, "part int, packed binary")


def _meet(sent: DataFrame, parts: int) -> DataFrame:
    """Pairs and stars of the signatures that meet in one part."""

    def run(batches):
        steady_memory()
        held, of = [], None

        def met():
            sig, doc = _in_order(np.concatenate([g[0] for g in held]), np.concatenate([g[1] for g in held]))
            a, b, star_sig, leader, member = split_groups(sig, doc)
            stars = np.concatenate([g[2] for g in held], axis=1)
            if stars.shape[1]:  # stars of batches get the group's smallest as their leader too, through their own
                starts, _ = groups(sig)
                where = starts[np.searchsorted(sig[starts], stars[0].view(np.uint64))]
                yield _found(STAR, doc[where], stars[2], stars[0])
                yield _found(PAIR, np.minimum(stars[1], stars[2]), np.maximum(stars[1], stars[2]), stars[0] * 0)
            if len(a):
                pairs = np.unique(np.stack([a, b]), axis=1)
                yield _found(PAIR, pairs[0], pairs[1], pairs[0] * 0)
            yield _found(STAR, leader, member, star_sig)

        for records in batches:  # sorted by part, so one part is held at a time
            for part, packed in zip(records.column(0).to_pylist(), records.column(1), strict=True):
                if held and part != of:
                    yield from met()
                    held = []
                raw, of = np.frombuffer(packed.as_buffer(), np.uint8).copy(), part
                n, s = raw[:16].view(np.int64)
                body = raw[16:].view(np.int64)
                held.append((body[:n].view(np.uint64), body[n : 2 * n], body[2 * n :].reshape(3, s)))
        if held:
            yield from met()

    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(run, FOUND)


#: Cells of a set's sketch.
CELLS = 256
#: Members of a group on either side of a cell that is compared at once.
BLOCK = 512
#: Pairs that a member names of one component at first, in one cell; the rest only if these link neither.
NAMED = 16


def sketches(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many shingles fall into each of 256 cells, one byte each (255: so many or more).

    Sets differ in at least as many shingles as their sketches' cells differ
    in sum, so a sum above the limit rules a pair out for certain.
    """
    rows = len(at) - 1
    cell = np.repeat(np.arange(rows), np.diff(at)) * CELLS + (mix64(hashes) >> np.uint64(56)).astype(np.int64)
    return np.minimum(np.bincount(cell, minlength=rows * CELLS), 255).astype(np.uint8).reshape(rows, CELLS)


def set_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest (lo, hi) and the sketch of every document's set."""

    def run(batches):
        for records in batches:
            out = np.zeros((3, records.num_rows), np.int64)
            drawn = np.zeros((records.num_rows, CELLS), np.uint8)
            for first, last, hashes, at in shingle_sets(records.column(1)):
                sizes = np.diff(at)
                full = sizes > 0
                drawn[first:last] = sketches(hashes, at)
                out[0, first:last] = sizes
                if full.any():
                    for k, value in ((1, mix64(hashes)), (2, mix64(hashes ^ np.uint64(0x5851F42D4C957F2D)))):
                        out[k, first:last][full] = np.add.reduceat(value, at[:-1][full]).view(np.int64)
            sketch = pa.array([x.tobytes() for x in drawn], pa.binary())
            yield pa.RecordBatch.from_arrays([records.column(0), *[pa.array(x) for x in out], sketch], names=["doc_id", "n_shingles", "lo", "hi", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, lo long, hi long, sketch binary")


def _lists(hashes: np.ndarray, at: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(hashes.view(np.int64)))


def _sets(docs: DataFrame) -> DataFrame:
    def run(batches):
        for records in batches:
            for first, last, hashes, at in shingle_sets(records.column(1)):
                yield pa.RecordBatch.from_arrays([records.column(0).slice(first, last - first), _lists(hashes, at)], names=["id", "shingles"])

    return docs.mapInArrow(run, "id long, shingles array<long>")


def _only(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``docs`` by a semi or anti join with ``ids`` (id), broadcast only while those are few."""
    few = ids.count() <= BROADCAST_IDS
    return docs.alias("d").join((F.broadcast(ids) if few else ids).alias("i"), F.col("d.doc_id") == F.col("i.id"), how)


def _plausible(base: DataFrame, pairs: DataFrame) -> DataFrame:
    """The distinct ``pairs`` (a, b) that the sketches don't rule out."""
    known = base.where("n_shingles > 0 and doc_id is not null")
    left = known.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("ka"))
    right = known.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("kb"))

    def run(batches):
        for records in batches:
            if not records.num_rows:
                continue
            x, y = (buffers(records.column(i))[0].reshape(-1, CELLS) for i in (3, 5))
            far = np.abs(x.astype(np.int32) - y).sum(axis=1)
            both = records.column(2).to_numpy() + records.column(4).to_numpy()
            keep = pa.array((SHARED + ALL) * (both - far) >= 2 * SHARED * both)
            yield pa.RecordBatch.from_arrays([records.column(0).filter(keep), records.column(1).filter(keep)], names=["a", "b"])

    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "na", "ka", "nb", "kb")
    return joined.mapInArrow(run, "a long, b long").distinct()


def _compared(docs: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """Of ``pairs`` (a, b) those whose sets are similar, as links (u, v)."""
    ids = materialize(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), f"{name}-ids", small=True)
    sets = _sets(_only(docs, ids, "left_semi"))
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(right, "b").join(left, "a")
    common = F.size(F.array_intersect("sa", "sb"))
    links = both.withColumn("common", common).where(F.col("common") * ALL >= SHARED * (F.size("sa") + F.size("sb") - F.col("common")))
    return materialize(links.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), f"{name}-links", small=True)


def _connecting(docs: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """Links among the plausible ``pairs`` (a < b) that connect all similar ones.

    Of many pairs, each b is compared with its smallest a first. A pair whose sides are then
    linked with the same document is connected already and isn't compared.
    """
    pairs = materialize(pairs, f"{name}-pairs", small=True)
    n = pairs.count()
    if not n:
        return pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if n <= DIRECT:
        return _compared(docs, pairs, name)
    first = pairs.groupBy("b").agg(F.min("a").alias("a"))
    links = _compared(docs, first, f"{name}-first")
    to = lambda side: links.select(F.col("v").alias(side), F.col("u").alias(f"to_{side}"))
    rest = pairs.join(first, ["a", "b"], "left_anti").join(to("a"), "a", "left").join(to("b"), "b", "left")
    rest = materialize(rest.where(F.coalesce("to_a", "a") != F.coalesce("to_b", "b")).select("a", "b"), f"{name}-rest", small=True)
    return links.unionByName(_compared(docs, rest, f"{name}-second")) if rest.limit(1).count() else links


def _torn_members(found: DataFrame, merged: DataFrame, name: str) -> DataFrame:
    """(sig, b, c) of the star groups whose members are in several components c."""
    stars = found.where(F.col("kind") == STAR)
    label = lambda df, key: df.join(_rooted(merged, key), key, "left").withColumn(f"c_{key}", F.coalesce(f"c_{key}", key))
    split = label(label(stars.select("a", "b").distinct(), "a"), "b").where("c_a <> c_b").select("a", "b")
    torn = stars.join(split, ["a", "b"], "left_semi").select("sig").distinct()
    return materialize(label(stars.join(torn, "sig", "left_semi").select("sig", "b").distinct(), "b").withColumnRenamed("c_b", "c"), f"members-{name}", small=True)


def _sizes(members: DataFrame) -> DataFrame:
    """sig, its members g, the most of them in one component (top, the component most), of torn groups only."""
    each = members.groupBy("sig", "c").agg(F.count("*").alias("m"))
    return each.groupBy("sig").agg(F.sum("m").alias("g"), F.max(F.struct("m", "c")).alias("t"), F.count("*").alias("n")).where("n > 1").select("sig", "g", F.col("t.m").alias("top"), F.col("t.c").alias("most"))


def _by_text(docs: DataFrame, members: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over (doc_id, text, sigs, sizes) of the documents in ``members`` (b, sig, g)."""
    own = materialize(members.groupBy(F.col("b").alias("id")).agg(F.collect_list(F.struct("sig", "g")).alias("own")), "own", small=True)
    weight = own.agg(F.coalesce(F.sum(F.size("own") * 16 + 64), F.lit(0)).alias("bytes")).first()["bytes"]
    return docs.join(F.broadcast(own) if weight <= BROADCAST_BYTES else own, F.col("doc_id") == F.col("id")).select("doc_id", "text", F.col("own.sig").alias("sigs"), F.col("own.g").alias("sizes")).mapInArrow(run, schema)


def needed(sig: np.ndarray, size: np.ndarray, spare: int, partitions: int) -> np.ndarray:
    """Which of a set's common signatures (of one parity) must be looked at, by their groups' sizes.

    Two similar sets share signatures of more than ``spare`` partitions. The
    one that comes first by size and signature has so many partitions with a
    signature behind it in both sets, so one with fewer isn't it.
    """
    order = np.lexsort((sig, size))
    rank = np.empty(len(sig), np.int64)
    rank[order] = np.arange(len(sig))
    # Beyond the partitions that a signature can name, each one counts as of its own.
    _, tag = np.unique(sig >> 1 & TAGS, return_inverse=True) if partitions <= TAGS + 1 else (None, rank)
    last = np.full(len(sig), -1)
    np.maximum.at(last, tag, rank)
    behind = np.sort(last[last >= 0])
    return len(behind) - np.searchsorted(behind, rank, side="right") - (last[tag] > rank) >= spare


def _pruned(docs: DataFrame, members: DataFrame, spread: float) -> DataFrame:
    """Of ``members`` (sig, b, c, g) those that must be looked at, as (b, sig)."""

    def run(batches):
        for records in batches:
            ids, sigs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for first, last, hashes, at in shingle_sets(records.column(1)):
                for side in (0, 1):
                    band = _instances(np.diff(at), side)
                    spare, partitions = signatures(hashes, at, band, SEED, spread)[2], first_level(band, spread)[1]
                    for r in np.flatnonzero(band >= 0):
                        sig, size = (records.column(c)[first + r].values.to_numpy() for c in (2, 3))
                        own = (sig & 1) == (band[r] & 1)
                        sig = sig[own][needed(sig[own], size[own], spare[r], partitions[r])]
                        sigs.append(sig)
                        ids.append(np.full(len(sig), records.column(0)[first + r].as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(sigs))], names=["b", "sig"])

    return _by_text(docs, members.select("b", "sig", "g"), run, "b long, sig long").distinct()


def _rekeyed(docs: DataFrame, members: DataFrame, spread: float, seed: int) -> DataFrame:
    """Stars of ``members`` (sig, b) by their signature and one of a fresh set of partitions."""

    def packed(ids, sigs):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *ids])), pa.array(np.concatenate([np.zeros(0, np.int64), *sigs]))], names=["b", "sig"])

    def run(batches):
        ids: list[np.ndarray] = []
        sigs: list[np.ndarray] = []
        held = 0
        for records in batches:
            for first, last, hashes, at in shingle_sets(records.column(1)):
                for side in (0, 1):
                    band = _instances(np.diff(at), side)
                    fresh, row, spare = signatures(hashes, at, band, seed, spread)
                    alone, alone_row, _ = signatures(hashes, at, np.where(spare < 0, band, -1), seed + 1, None)
                    for r in np.flatnonzero(band >= 0):
                        old = records.column(2)[first + r].values.to_numpy()
                        new = np.concatenate([fresh[row == r], alone[alone_row == r]])
                        for sig in old[(old & 1) == (band[r] & 1)].view(np.uint64):
                            made = np.unique(mix64(new ^ mix64(np.full(1, sig))) & ~np.uint64(1) | np.uint64(band[r] & 1))
                            sigs.append(made.view(np.int64))
                            ids.append(np.full(len(made), records.column(0)[first + r].as_py(), np.int64))
                            held += len(made)
                            if held >= FLUSH:
                                yield packed(ids, sigs)
                                ids, sigs, held = [], [], 0
        yield packed(ids, sigs)

    made = materialize(_by_text(docs, members.select("b", "sig", F.lit(0).cast("long").alias("g")), run, "b long, sig long"), "rekeyed")
    least = made.groupBy("sig").agg(F.min("b").alias("a"), F.max("b").alias("z")).where("a <> z").select("sig", "a")
    return materialize(made.join(least, "sig").select(F.lit(STAR).alias("kind"), "a", "b", "sig"), "found-rekeyed")


def _runs(batches, keys: int) -> Iterator[list[pa.RecordBatch]]:
    """The rows of sorted batches, cut where one of the first ``keys`` columns changes, some groups at a time."""
    held = None
    for records in batches:
        table = pa.Table.from_batches([records] if held is None else [*held.to_batches(), records]).combine_chunks()
        if not table.num_rows:
            continue
        values = [table.column(i).to_numpy() for i in range(keys)]
        same = np.logical_and.reduce([v == v[-1] for v in values])
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut)
    if held is not None and held.num_rows:
        yield held


def _within(base: DataFrame, members: DataFrame, every: bool, block: int = BLOCK) -> DataFrame:
    """Plausible pairs (a, b, sig) of different components in one group of ``members`` (sig, b, c, g, top, most).

    Members outside a group's largest component meet all others. Both are
    dealt into blocks, and each cell of two blocks is compared by sketches
    where it lies, so no task holds more than two blocks of a group and no
    pair that is ruled out becomes a row. Without ``every`` a member names its
    ``NAMED`` closest of each component in the cell; ``sig`` is given where it
    has more, else 0.
    """
    blocks = lambda n: F.ceil(n / F.lit(block)).cast("int")
    placed = members.withColumn("across", blocks(F.col("g"))).withColumn("down", blocks(F.col("g") - F.col("top")))
    deal = lambda n: F.pmod(F.xxhash64("b", F.lit(3)), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    large = placed.select("sig", deal("across").alias("x"), spread("down").alias("y"), F.lit(False).alias("probe"), "b", "c")
    small = placed.where("c <> most").select("sig", deal("down").alias("y"), spread("across").alias("x"), F.lit(True).alias("probe"), "b", "c")
    known = base.where("n_shingles > 0 and doc_id is not null").select(F.col("doc_id").alias("b"), "n_shingles", "sketch")
    rows = large.unionByName(small).join(known, "b").select("sig", "x", "y", "probe", "b", "c", "n_shingles", "sketch")

    def run(batches):
        for table in _runs(batches, 3):
            sig, x, y, probe, ids, comp, n = (table.column(i).to_numpy() for i in range(7))
            drawn = buffers(table.column(7))[0].reshape(-1, CELLS)
            edge = np.flatnonzero((sig[1:] != sig[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
            a, b, over = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for lo, hi in zip(np.append(0, edge), np.append(edge, len(sig)), strict=True):
                own = np.arange(lo, hi)
                for i, j, more in close_pairs(own[~probe[lo:hi]], own[probe[lo:hi]], drawn, n, comp, len(sig) if every else NAMED):
                    a.append(np.minimum(ids[i], ids[j]))
                    b.append(np.maximum(ids[i], ids[j]))
                    over.append(np.where(more, sig[lo], 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b, over)], names=["a", "b", "sig"])

    return rows.repartition("sig", "x", "y").sortWithinPartitions("sig", "x", "y").mapInArrow(run, "a long, b long, sig long").where("a <> b").distinct()


def close_pairs(members: np.ndarray, probes: np.ndarray, drawn: np.ndarray, n: np.ndarray, comp: np.ndarray, named: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(members, probe, whether it has more there) of different components that the sketches don't rule out."""
    wide = drawn[members].astype(np.int16)
    for j in probes if len(members) else ():
        both = n[members] + n[j]
        other = np.flatnonzero((comp[members] != comp[j]) & (ALL * np.minimum(n[members], n[j]) >= SHARED * np.maximum(n[members], n[j])))
        if not len(other):
            continue
        far = np.abs(wide[other] - drawn[j]).sum(axis=1)
        near = (SHARED + ALL) * (both[other] - far) >= 2 * SHARED * both[other]
        if near.any():
            order = np.lexsort((far[near], comp[members[other[near]]]))
            other = members[other[near][order]]
            starts, lengths = groups(comp[other])
            rank = np.arange(len(other)) - np.repeat(starts, lengths)
            yield other[rank < named], j, np.repeat(lengths > named, lengths)[rank < named]


def jaccard_components(docs: DataFrame, *, spread: float = SPREAD, most: int = MOST_PAIRS) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest reachable doc_id) of every row.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text of one to
    four words has its whole sequence as one shingle; without words or text
    the set is empty and linked with nothing.

    Defined cases: rows of one ``doc_id`` are one vertex and each keeps its own
    ``n_shingles``; rows without ``doc_id`` are linked with nothing and have a
    null component; an empty table gives no rows; other columns are ignored.
    """
    with small_batches(docs.sparkSession):
        return _components(docs, spread, most)


def _components(docs: DataFrame, spread: float, most: int) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = materialize(set_digests(docs), "sets")
    usable = base.where("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy("lo", "hi").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep <> last").select("lo", "hi", "rep")
    # From a table of their own, so that the planner can split a set that very many documents have.
    classes = materialize(classes, "classes", small=True)
    equal = materialize(usable.select("doc_id", "lo", "hi").join(classes, ["lo", "hi"]).select("doc_id", "rep").where("doc_id <> rep").distinct(), "equal", small=True)
    known = docs.where("doc_id is not null")
    work = _only(known, equal.select(F.col("doc_id").alias("id")).distinct(), "left_anti")
    twice = usable.select("doc_id", "lo", "hi").distinct().groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("id"))
    several = bool(twice.limit(1).count())
    if several:  # ids of several texts: none of these may be left out
        work = work.unionByName(_only(known, twice, "left_semi")).distinct()
    parts = 1 << max(3, (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    with small_batches(spark, PARCELS):
        found = materialize(_meet(_send(work, parts, spread), parts), "found")
    merged = None
    for level in range(LEVELS + 1):
        merged = _with_links(merged, _connecting(known, _plausible(base, found.where("a <> b").select("a", "b").distinct()), f"verify-{level}"))
        members = _torn_members(found, merged, str(level))
        if not members.limit(1).count():
            break
        sizes = materialize(_sizes(members), f"sizes-{level}", small=True)
        # Pairs of a group: all of its members with those outside its largest component.
        few = F.col("g") * (F.col("g") - F.col("top")) <= most if level < LEVELS else F.lit(True)
        near = materialize(members.join(sizes.where(few), "sig"), f"torn-{level}", small=True)
        pairs = materialize(_within(base, near, False), f"within-{level}", small=True)
        merged = _with_links(merged, _connecting(known, pairs.select("a", "b").distinct(), f"again-{level}"))
        if pairs.where("sig <> 0").limit(1).count():  # where some have more to name and weren't linked
            apart = pairs.where("sig <> 0").join(_rooted(merged, "a"), "a", "left").join(_rooted(merged, "b"), "b", "left")
            apart = apart.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("sig").distinct()
            near = materialize(_relabelled(near.join(apart, "sig", "left_semi"), merged), f"near-{level}", small=True)
            near = materialize(near.join(_sizes(near), "sig"), f"near-sized-{level}", small=True)
            pairs = materialize(_within(base, near, True).join(pairs, ["a", "b"], "left_anti").select("a", "b").distinct(), f"rest-{level}", small=True)
            merged = _with_links(merged, _connecting(known, pairs, f"last-{level}"))
        if not sizes.where(~few).limit(1).count():
            break
        large = _relabelled(members.join(sizes.where(~few).select("sig"), "sig", "left_semi"), merged)
        large = materialize(large.join(_sizes(large).select("sig", "g"), "sig"), f"large-{level}", small=True)
        if level == 0:
            large = materialize(_pruned(known, large, spread), "needed", small=True)
        if not large.limit(1).count():
            break
        found = _rekeyed(known, large, spread, SEED + 1000 * (level + 1))
    same = equal.select(F.col("doc_id").alias("id"), F.col("rep").alias("component"))
    if several:  # an id may be a copy in one row and something else in another
        merged = _with_links(merged, same.select(F.col("id").alias("u"), F.col("component").alias("v")))
    else:
        of_rep = merged.select(F.col("id").alias("component"), F.col("component").alias("root"))
        merged = merged.unionByName(same.join(of_rep, "component", "left").select("id", F.coalesce("root", "component").alias("component")))
    joined = base.select("doc_id", "n_shingles").join(merged.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _rooted(merged: DataFrame, key: str) -> DataFrame:
    """(key, c_key): the component of each document that isn't its component's smallest."""
    return merged.select(F.col("id").alias(key), F.col("component").alias(f"c_{key}"))


def _with_links(merged: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components (id, component) after further links (u, v): those between present components are contracted alone."""
    if merged is None:
        return connected_components(links)
    if not links.limit(1).count():
        return merged
    ends = links.join(_rooted(merged, "u"), "u", "left").join(_rooted(merged, "v"), "v", "left").select(F.coalesce("c_u", "u").alias("u"), F.coalesce("c_v", "v").alias("v"))
    fresh = connected_components(ends)
    moved = merged.join(fresh.select(F.col("id").alias("component"), F.col("component").alias("now")), "component", "left").select("id", F.coalesce("now", "component").alias("component"))
    return materialize(moved.unionByName(fresh), "merged", small=True)


def _relabelled(members: DataFrame, merged: DataFrame) -> DataFrame:
    """``members`` (sig, b, c) with their present components."""
    to = merged.select(F.col("id").alias("c"), F.col("component").alias("now"))
    return members.join(to, "c", "left").select("sig", "b", F.coalesce("now", "c").alias("c"))


def one_of_each_group(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``docs`` without those that have a smaller id in their component, and one row for each id.

    Of rows with one id that of the first text stays, by code point, null
    first. Rows without an id stay. All columns are kept, whatever their names.
    """
    gone = materialize(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct(), "gone", small=True)
    kept = _only(docs, gone, "left_anti")
    again = groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("id"))
    if again.limit(1).count():
        rows = _only(kept, again, "left_semi").select("doc_id", F.struct("*").alias("row"))
        first = F.struct(F.coalesce("row.text", F.lit("")), F.to_json("row"))
        once = rows.groupBy("doc_id").agg(F.min_by("row", first).alias("row")).select("row.*")
        kept = _only(kept, again, "left_anti").unionByName(once)
    return kept
