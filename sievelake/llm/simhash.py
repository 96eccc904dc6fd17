"""Near-duplicate documents by SimHash, compared at the anchor points of a covering code.

A fingerprint has 64 bits. If two differ in at most t bits, one of their two
halves differs in at most t // 2. The anchors of a half are the codewords of the
[31, 26] Hamming code on its low 31 bits: a perfect code, whose covering radius
is 1, so every half has an anchor within 1. If two halves differ in at most d
bits, there is a word m within ceil(d / 2) of both, and m's anchor lies within
1 + ceil(d / 2) of both. So each half is replicated to every anchor within the
covering radius plus half the threshold, 16 anchors where the half may differ in
2 bits, and every linked pair meets at an anchor at least. (Replicating only one
side takes the whole threshold and some 150 anchors for the same pairs.)

Equal fingerprints are one point. The points of an anchor are compared in
blocks, and only the edges of a spanning forest leave the task. Anchors with more
points than a task may hold are taken apart further: each point goes to every word
within half the threshold of it, rounded up, and all points of a word link to one
that is within half, rounded down, which needs no comparison at all. Then
distributed label propagation over the written edges finds the components.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, partitions, prepare
from .components import components, forest

#: Points of one anchor that a task compares in memory; larger groups are taken apart.
HOLD = 1 << 15


def fingerprint(text: bytes, shingle: int) -> int:
    """SimHash of the word shingles of a text, whose letters A to Z count as small ones; 0 without words.

    A bit is 1 if it is set in over half of the shingles' XXH64 (seed 42).
    """
    import xxhash

    words = text.lower().split()  # of bytes: only A to Z become small, only the blank and 0x09 to 0x0D separate
    n = len(words)
    if not n:
        return 0
    if n <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    of = xxhash.xxh64_intdigest

    def hashes() -> Iterator[np.ndarray]:
        for at in range(0, n - shingle + 1, 1 << 16):
            some = words[at : at + (1 << 16) + shingle - 1]
            joined = b" ".join(some)
            ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1)
            starts = np.concatenate(([0], ends[:-1]))[: len(some) - shingle + 1].tolist()
            yield np.array([of(joined[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())], dtype="<u8")

    return majority(hashes())


def majority(parts: Iterable[np.ndarray]) -> int:
    """The bits that are set in over half of the hashes (64 bits), which come in parts."""
    counts, n = np.zeros(64, dtype=np.int64), 0
    for hashes in parts:
        counts += np.unpackbits(hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row; null texts have no words."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint((t.as_py() or "").encode("utf-8", "surrogatepass"), shingle) for t in batch.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def syndrome(half: np.ndarray) -> np.ndarray:
    """The syndrome of 31-bit words: the exclusive or of the numbers (1 to 31) of the bits set."""
    out = np.zeros(len(half), dtype=np.uint64)
    for bit in range(31):
        out ^= ((half >> np.uint64(bit)) & np.uint64(1)) * np.uint64(bit + 1)
    return out


def anchors(half: np.ndarray, flips: int) -> np.ndarray:
    """The codewords next to every word within so many flips of the 31-bit half; a row for each word, with repeats.

    Decoding flips the bit that the syndrome names.
    """
    half = half & np.uint64(0x7FFFFFFF)
    masks = [sum(1 << b for b in bits) for k in range(flips + 1) for bits in combinations(range(31), k)]
    moved = (half[:, None] ^ np.array(masks, dtype=np.uint64)[None, :]).ravel()
    s = syndrome(moved)
    words = moved ^ np.where(s > 0, np.uint64(1) << (np.maximum(s, np.uint64(1)) - np.uint64(1)), np.uint64(0))
    return words.reshape(len(half), -1)


def edges(points: DataFrame, threshold: int, hold: int) -> DataFrame:
    """Links (a, b), both fingerprints, that join whatever differs in at most threshold bits, directly or by way of others."""
    spark = points.sparkSession
    flips = -(-(threshold // 2) // 2)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(whole), 4096):
                fp = whole[at : at + 4096]
                keys, points = [], []
                for side, shift in ((0, 0), (1, 32)):
                    words = np.sort(anchors(fp >> np.uint64(shift), flips), axis=1)
                    new = np.ones(words.shape, dtype=bool)
                    new[:, 1:] = words[:, 1:] != words[:, :-1]
                    keys.append(words[new] | np.uint64(side << 32))
                    points.append(np.repeat(fp, new.sum(axis=1)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(points).view(np.int64))], names=["anchor", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor; an anchor's points are held until the next begins, or until they are too many."""
        none = np.zeros(0, dtype=np.int64)

        def out(a: np.ndarray, b: np.ndarray, large: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), large))], names=["a", "b", "large"])

        def link(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return forest(points, lambda x, y: np.bitwise_count(x.view(np.uint64)[:, None] ^ y.view(np.uint64)[None, :]) <= threshold)

        held, anchor, large = [none], None, False
        for batch in batches:
            keys, fps = batch.column("anchor").to_numpy(), batch.column("fp").to_numpy()
            if not len(keys):
                continue
            start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            end = np.append(start[1:], len(keys))
            several = end - start > 1
            several[[0, -1]] = True  # the others are alone at their anchor
            a, b = [none], [none]
            for s, e in zip(start[several].tolist(), end[several].tolist()):
                if keys[s] != anchor:
                    if not large and sum(map(len, held)) > 1:
                        for to, new in zip((a, b), link(np.concatenate(held))):
                            to.append(new)
                    held, anchor, large = [none], keys[s], False
                held.append(fps[s:e])
                if large or sum(map(len, held)) > hold:
                    whole = np.concatenate(held)
                    held, large = [none], True
                    yield out(whole, whole, True)
            yield out(np.concatenate(a), np.concatenate(b), False)
        if sum(map(len, held)) > 1 and not large:
            yield out(*link(np.concatenate(held)), False)

    def surround(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = np.array([sum(1 << b for b in bits) for k in range(-(-threshold // 2) + 1) for bits in combinations(range(64), k)], dtype=np.uint64)
        close = np.bitwise_count(masks) <= threshold // 2
        step = max(1, (1 << 20) // len(masks))
        for batch in batches:
            whole = batch.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(whole), step):
                fp = whole[at : at + step]
                yield pa.RecordBatch.from_arrays([pa.array((fp[:, None] ^ masks[None, :]).ravel().view(np.int64)), pa.array(np.repeat(fp, len(masks)).view(np.int64)), pa.array(np.tile(close, len(fp)))], names=["word", "fp", "close"])

    n = partitions(points)
    met = points.mapInArrow(replicate, "anchor long, fp long").repartition(n, "anchor").sortWithinPartitions("anchor", "fp")
    found = materialise(met.mapInArrow(compare, "a long, b long, large boolean"), "links")
    direct = found.where("not large").select("a", "b")
    if found.where("large").isEmpty():
        return direct
    near = found.where("large").select(F.col("a").alias("fp")).distinct().mapInArrow(surround, "word long, fp long, close boolean")
    least = near.groupBy("word").agg(F.min(F.when(F.col("close"), F.col("fp"))).alias("a"), F.min("fp").alias("low"), F.max("fp").alias("high")).where("a IS NOT NULL AND low < high").select("word", "a")
    return direct.unionByName(near.join(least, "word").where("fp <> a").select("a", F.col("fp").alias("b")).distinct())


def simhash_groups(docs: DataFrame, shingle: int = 4, threshold: int = 4, hold: int = HOLD) -> DataFrame:
    """Groups documents whose fingerprints differ in at most threshold bits, directly or by way of others.

    Returns doc_id, fingerprint (16 hexadecimal digits) and component_id (the
    smallest doc_id of the group) for every row of docs (doc_id, text; other
    columns aren't read). Null and empty texts have fingerprint zero, which links
    like any other; texts with fewer words than a shingle have one shingle, the
    whole. Repeated rows come out as often as they came in; a null doc_id takes
    part, but never names a group unless the whole group has none. An empty table
    gives no rows.
    """
    of = materialise(fingerprints(docs, shingle), "fingerprints")
    least = of.groupBy("fp").agg(F.min("doc_id").alias("node"))
    points = materialise(least, "points")
    links = edges(points.select("fp"), threshold, hold)
    left, right = points.select(F.col("fp").alias("a"), F.col("node").alias("u")), points.select(F.col("fp").alias("b"), F.col("node").alias("v"))
    named = links.join(left, "a").join(right, "b").select("u", "v")
    roots = components(named)
    whole = points.join(roots, points.node == roots.node, "left").select("fp", F.coalesce("root", points.node).alias("component_id"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return of.join(whole, "fp").select("doc_id", digits, "component_id")
