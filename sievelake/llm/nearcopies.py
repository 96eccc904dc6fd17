"""Near copies for a corpus pipeline: fingerprints propose, the shingles decide.

The SimHash operator proposes first: texts whose fingerprints of word shingles
differ in at most BITS bits meet at the anchors of its covering code. That is most
copies, but at a similarity of 0.8 two fingerprints differ in ten bits of 64, and
in far more where an end is cut off, which no covering code reaches at a bearable
cost. So min-hashes propose, too: the MINS min-hashes of a text's distinct shingles
agree with those of another text with the probability of their Jaccard similarity,
whatever the edits are. Bands of BAND min-hashes are the anchors where texts meet: at a
similarity of 0.8 two texts miss each other at all of them once in twenty million
times. One bit of each min-hash makes a sketch of 128 bits, whose distance at an
anchor tells candidates from chance.

Candidates come in two rounds. In the first come the links of SimHash, and at each
band a document's link to the nearest earlier one; links count if the sets of word
shingles, compared whole, have the similarity asked for. That joins large groups by
few links. In the second every pair at a band that the first left in different
components is compared by sketch, so neither a nearer candidate that failed nor the
size of a band hides one. A second sketch, of BINS one-permutation min-hashes, which
comes only to bands with several components, leaves out pairs whose similarity it puts
DEVIATIONS standard deviations below the one asked for (bins hold a sample of both sets
together, without replacement), and a pair counts at the first band that it shares only. Bands with more points than a task may hold are taken apart:
blocks of points, and a task for each two blocks. Only the shingles of documents with a
link are shuffled, not texts: a bitmap tells the scan which documents these are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, discard, grams, materialise, mix, partitions, prepare, released, word_hashes
from .components import components
from .simhash import edges, majority

#: Points of a band that a task holds. The first round compares later points with these and with their own block of as many, the second all.
HOLD = 1 << 13
#: Bits in which SimHash fingerprints of candidates differ at most.
BITS = 4
#: Min-hashes of a text, and of a band.
MINS, BAND = 128, 4
#: Bits of 128 in which sketches of candidates may differ: 12.8 are expected at the similarity of 0.8, with a deviation of 3.4.
NEAR = 32
#: Bins of the second sketch, a byte each, and how far below the similarity asked for its estimate may be.
BINS, DEVIATIONS = 256, 4
#: The bitmap that tells which documents to take shingles of has 2**20 to 2**30 bits, sixteen a link; where it errs, it takes too many.
FILTER_BITS = (20, 30)
_FACTORS, _TERMS = mix(np.arange(1, MINS + 1, dtype=np.uint64)) | np.uint64(1), mix(np.arange(MINS + 1, 2 * MINS + 1, dtype=np.uint64))


def sketches_of(text: str | None, shingle: int) -> tuple[int, int, int, bytes, bytes, int]:
    """Of a text, its SimHash by all word shingles, repeats included, and the sketches and the size of their set (the whole text is one, if it has fewer words)."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    found = grams(words, min(shingle, max(1, len(words))))
    own = np.unique((found >> np.uint64(32)).astype(np.uint32))
    x, y, anchors = sketch_of(own)
    return int(np.uint64(majority([found])).view(np.int64)), x, y, anchors, bins_of(own), len(own)


def bins_of(shingles: np.ndarray) -> np.ndarray:
    """A byte of the smallest hash of a set of shingles in each bin of hashes; 0 for empty bins."""
    sorted_ = np.sort(mix(shingles.astype(np.uint64) + np.uint64(MINS)))
    at = np.searchsorted(sorted_, np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1))
    there = np.diff(np.append(at, len(sorted_))) > 0
    out = np.zeros(BINS, dtype=np.uint8)
    out[there] = sorted_[at[there]] % np.uint64(255) + np.uint64(1)
    return out.tobytes()


def sketch_of(shingles: np.ndarray) -> tuple[int, int, bytes]:
    """Two words of a sketch and the anchors (64 bits each) of a set of shingles; no anchors if it is empty."""
    if not len(shingles):
        return 0, 0, b""
    least = np.full(MINS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 1 << 12):
        some = mix(shingles[at : at + (1 << 12)].astype(np.uint64))
        np.minimum(least, (some[:, None] * _FACTORS + _TERMS).min(axis=0), out=least)
    x, y = np.packbits((mix(least) & np.uint64(1)).astype(np.uint8), bitorder="little").view("<i8").tolist()
    return x, y, mix(grams_by_row(least.reshape(-1, BAND)) + np.arange(MINS // BAND, dtype=np.uint64)).tobytes()


def grams_by_row(rows: np.ndarray) -> np.ndarray:
    """A hash of each row."""
    acc = np.zeros(len(rows), dtype=np.uint64)
    for column in rows.T:
        acc = mix(acc + column)
    return acc


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct hashes (32 bits) of the word shingles of a text; of the whole, if it has fewer words."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    return np.unique((grams(words, min(shingle, max(1, len(words)))) >> np.uint64(32)).astype(np.uint32))


def membership(ids: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2**bits for the hashes of doc_id: it says no only to ids that aren't there."""
    slots = ids.select(F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - bits).alias("slot"))
    words = slots.groupBy(F.expr("cast(slot div 64 AS int)").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 AS int)))").alias("word")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[words.column("at").to_numpy()] = words.column("word").to_numpy().view(np.uint64)
    return out


def _nearest(points: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """For the points (node, two fingerprints) from number first on, their number and that of the nearest earlier one, where it is near."""
    a, b = points[:, 1].view(np.uint64), points[:, 2].view(np.uint64)
    me, other = [], []
    step = max(1, (1 << 21) // len(points))
    for at in range(first, len(points), step):
        to = min(len(points), at + step)
        d = np.bitwise_count(a[at:to, None] ^ a[None, :to]).astype(np.int16) + np.bitwise_count(b[at:to, None] ^ b[None, :to])
        d[np.arange(to)[None, :] >= np.arange(at, to)[:, None]] = 999
        best = d.argmin(axis=1)
        near = d[np.arange(to - at), best] <= NEAR
        me.append(np.arange(at, to)[near])
        other.append(best[near])
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(me), np.concatenate(other)) if me else (none, none)


class _Points:
    """Points of a band: rows of node, sketch (two longs), component and size, their bins, and the anchors of all their bands."""

    def __init__(self, rows: np.ndarray, bins: np.ndarray, anchors: np.ndarray) -> None:
        self.rows, self.bins, self.anchors = rows, bins, anchors

    @classmethod
    def of(cls, parts: list[tuple[np.ndarray, ...]]) -> _Points:
        none = (np.zeros((0, 5), dtype=np.int64), np.zeros((0, BINS), dtype=np.uint8), np.zeros((0, MINS // BAND), dtype=np.int64))
        return cls(*(np.concatenate(x) for x in zip(none, *parts)))


def _rest_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = np.stack([batch.column(k).to_numpy() for k in ("node", "x", "y", "component", "size")], axis=1)
    bins, anchors = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=t).reshape(len(rows), -1) for k, t in (("bins", np.uint8), ("anchors", np.int64)))
    return rows, bins, anchors


def _across(left: _Points, right: _Points, anchor: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Nodes of all near pairs of a left and a right point in different components that meet at no earlier band, the larger node first, in blocks."""
    a, b = right.rows[:, 1].view(np.uint64), right.rows[:, 2].view(np.uint64)
    step = max(1, (1 << 21) // max(1, len(a)))
    for at in range(0, len(left.rows), step):
        some = left.rows[at : at + step]
        x, y = (some[:, k].view(np.uint64)[:, None] for k in (1, 2))
        d = np.bitwise_count(x ^ a[None, :]).astype(np.int16) + np.bitwise_count(y ^ b[None, :])
        me, other = np.nonzero((d <= NEAR) & (some[:, 3][:, None] != right.rows[None, :, 3]))
        if left is right:
            me, other = (k[some[me, 0] > right.rows[other, 0]] for k in (me, other))
        for i in range(0, len(me), 1 << 14):
            p, q = me[i : i + (1 << 14)], other[i : i + (1 << 14)]
            u, v = left.bins[at + p], right.bins[q]
            either = np.maximum(1, ((u | v) > 0).sum(axis=1))
            alike = ((u == v) & (u > 0)).sum(axis=1) / either
            both = np.maximum(either, (some[p, 4] + right.rows[q, 4]) / (1 + similarity))
            near = alike >= similarity - DEVIATIONS * np.sqrt(similarity * (1 - similarity) / either * (1 - (either - 1) / both))
            p, q = p[near], q[near]
            here = left.anchors[at + p]
            first = here[np.arange(len(p)), (here == right.anchors[q]).argmax(axis=1)] == anchor
            p, q = some[p[first], 0], right.rows[q[first], 0]
            yield np.maximum(p, q), np.minimum(p, q)


def near_copy_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, hold: int = HOLD) -> DataFrame:
    """doc_id and component_id (the smallest doc_id of its group) of every distinct doc_id of docs (doc_id, text).

    Equal texts are linked, and texts whose shingle sets have a Jaccard similarity
    of at least ``similarity`` (0.8 or more, for which the search is made), directly
    or by way of others. Null texts count as empty ones, which are all equal. Rows that share
    a doc_id are one document. A null doc_id gives no row. Other columns aren't read.
    """
    spark = docs.sparkSession
    prepare(spark)
    n = partitions(docs)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sketches_of(t.as_py(), shingle) for t in batch.column("text")]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("same"), *(pa.array(c, k) for c, k in zip(zip(*found) if found else [[]] * 6, kinds))], names=["doc_id", "same", "fp", "x", "y", "anchors", "bins", "size"])

    rows = docs.where("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.withColumn("same", F.xxhash64("text"))
    of = materialise(keyed.select("doc_id", "same", "text").mapInArrow(released(sketch), "doc_id long, same long, fp long, x long, y long, anchors binary, bins binary, size long"), "sketches")
    points = materialise(of.groupBy("same", "x", "y", "fp").agg(F.min("doc_id").alias("node"), F.min("anchors").alias("anchors"), F.min("bins").alias("bins"), F.min("size").alias("size")), "points")

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "x", "y", "component"]
        for batch in batches:
            whole = np.stack([batch.column(k).to_numpy() for k in names], axis=1)
            lists = batch.column("anchors").to_pylist()
            for at in range(0, len(whole), 2048):
                some = lists[at : at + 2048]
                keys, rows = np.frombuffer(b"".join(some), dtype=np.int64), np.repeat(whole[at : at + 2048], [len(x) // 8 for x in some], axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(rows[:, c]) for c in range(4))], names=["anchor", *names])

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor and node; an anchor's first points stay, later ones pass in blocks. Each is linked to the nearest."""
        anchor, kept, block = None, np.zeros((0, 3), dtype=np.int64), []

        def settle() -> list[tuple[np.ndarray, np.ndarray]]:
            new = np.concatenate(block) if block else kept[:0]
            if not len(new) or len(kept) + len(new) < 2:
                return []
            both = np.concatenate([kept, new])
            me, other = _nearest(both, len(kept))
            return [(both[me, 0], both[other, 0])]

        for batch in batches:
            key = batch.column("anchor").to_numpy()
            if not len(key):
                continue
            rows = np.stack([batch.column(k).to_numpy() for k in ("node", "x", "y")], axis=1)
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            end = np.append(start[1:], len(key))
            several = end - start > 1
            several[[0, -1]] = True
            links = []
            for s, e in zip(start[several].tolist(), end[several].tolist()):
                if key[s] != anchor:
                    links += settle()
                    anchor, kept, block = key[s], rows[:0], []
                block.append(rows[s:e])
                if sum(map(len, block)) >= hold:
                    links += settle()
                    kept, block = (np.concatenate(block) if not len(kept) else kept), []
            a, b = (np.concatenate(x) for x in zip(*links)) if links else (np.zeros(0, dtype=np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        for a, b in settle():
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def propose_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All near pairs of an anchor in different components, and the points themselves of one with too many (as a); rows come sorted by anchor."""
        anchor, block, large = None, [], False
        none = np.zeros(0, dtype=np.int64)

        def settle() -> Iterator[pa.RecordBatch]:
            points = _Points.of(block)
            if large:
                yield pa.RecordBatch.from_arrays([pa.array(points.rows[:, 0]), pa.nulls(len(points.rows), pa.int64()), pa.array(np.full(len(points.rows), anchor))], names=["a", "b", "anchor"])
                return
            for a, b in _across(points, points, anchor, similarity) if block else ((none, none),):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], names=["a", "b", "anchor"])

        for batch in batches:
            key = batch.column("anchor").to_numpy()
            if not len(key):
                continue
            rows = _rest_rows(batch)
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            for s, e in zip(start.tolist(), [*start[1:].tolist(), len(key)]):
                if key[s] != anchor:
                    yield from settle()
                    anchor, block, large = key[s], [], False
                block.append(tuple(x[s:e] for x in rows))
                if sum(len(x[0]) for x in block) > hold:
                    large = True
                    yield from settle()
                    block = []
        yield from settle()

    def propose_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The near pairs between two blocks of an anchor, or within one; rows come sorted by anchor and blocks."""
        place, sides = None, {}

        def settle() -> Iterator[pa.RecordBatch]:
            if place is not None:
                left, right = (_Points.of(sides.get(k, [])) for k in place[1:])
                for a, b in _across(left, left if place[1] == place[2] else right, place[0], similarity):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in ("anchor", "low", "high", "own")], axis=1)
            rows = _rest_rows(batch)
            start = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1)))) if len(keys) else np.zeros(0, dtype=int)
            for s, e in zip(start.tolist(), [*start[1:].tolist(), len(keys)]):
                if (at := tuple(keys[s, :3].tolist())) != place:
                    yield from settle()
                    place, sides = at, {}
                sides.setdefault(int(keys[s, 3]), []).append(tuple(x[s:e] for x in rows))
        yield from settle()

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            maybe = np.flatnonzero((wanted[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1))
            some = batch.take(pa.array(maybe))
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array([shingle_set(t.as_py(), shingle).tobytes() for t in some.column("text")], pa.binary())], names=["node", "shingles"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = (np.frombuffer(v.as_py(), dtype=np.uint32) for v in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= similarity * max(1, len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def sure(links: DataFrame) -> DataFrame:
        """The links u, v whose shingle sets are as similar as asked for."""
        nonlocal wanted
        low, high = FILTER_BITS
        bits = min(high, max(low, (16 * links.count()).bit_length()))
        wanted = membership(links.select(F.col("a").alias("doc_id")).unionByName(links.select(F.col("b").alias("doc_id"))), bits)
        slotted = rows.select("doc_id", "text", F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - bits).alias("slot"))
        sets = materialise(slotted.mapInArrow(released(shingles), "node long, shingles binary"), "shingles")
        left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
        verified = links.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(released(verify), "a long, b long")
        out = materialise(verified.select(F.col("a").alias("u"), F.col("b").alias("v")), "sure")
        discard(sets)
        return out

    def apart(large: DataFrame, about: DataFrame) -> DataFrame:
        """The near pairs of anchors with more points (anchor, node) than a task may hold, by a task for each two blocks of them."""
        subs = large.groupBy("anchor").agg(F.ceil(F.count("*") / F.lit(hold)).cast("long").alias("subs"))
        own = large.join(subs, "anchor").withColumn("own", F.pmod(F.xxhash64("node"), F.col("subs")))
        met = own.withColumn("other", F.explode(F.expr("sequence(0L, subs - 1L)"))).withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
        rows = met.select("anchor", "low", "high", "own", "node").join(about, "node").repartition(n, "anchor", "low", "high")
        return rows.sortWithinPartitions("anchor", "low", "high", "own").mapInArrow(propose_blocks, "a long, b long")

    def met(labelled: DataFrame) -> DataFrame:
        return labelled.mapInArrow(released(replicate), "anchor long, node long, x long, y long, component long").repartition(n, "anchor").sortWithinPartitions("anchor", "node")

    wanted = np.zeros(0, dtype=np.uint64)
    fps = materialise(points.groupBy("fp").agg(F.min("node").alias("node")), "fps")
    ends = [fps.select(F.col("fp").alias(k), F.col("node").alias(to)) for k, to in (("a", "p"), ("b", "q"))]
    by_bits = edges(fps.select("fp"), BITS, hold).join(ends[0], "a").join(ends[1], "b").select(F.greatest("p", "q").alias("a"), F.least("p", "q").alias("b"))
    by_bits = by_bits.unionByName(points.join(fps.withColumnRenamed("node", "b"), "fp").select(F.col("node").alias("a"), "b"))
    by_band = met(points.withColumn("component", F.col("node"))).mapInArrow(released(propose), "a long, b long")
    nearest = materialise(by_bits.unionByName(by_band).where("a <> b").distinct(), "proposed")
    copies = of.join(points, ["same", "x", "y", "fp"]).where("doc_id <> node").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    found = copies.unionByName(sure(nearest))
    roots = components(found)
    labelled = points.join(roots, "node", "left").select("node", "x", "y", "anchors", "bins", "size", F.coalesce("root", "node").alias("component"))
    at_bands = labelled.mapInArrow(released(replicate), "anchor long, node long, x long, y long, component long").select("anchor", "node", "component")
    several = materialise(at_bands.groupBy("anchor").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("anchor"), "several")
    about = labelled.select("node", "x", "y", "component", "bins", "anchors", "size")
    some = at_bands.select("anchor", "node").join(several, "anchor", "left_semi").join(about, "node").repartition(n, "anchor").sortWithinPartitions("anchor")
    left = materialise(some.mapInArrow(released(propose_rest), "a long, b long, anchor long"), "left")
    large, pairs = left.where("anchor IS NOT NULL").select("anchor", F.col("a").alias("node")), left.where("anchor IS NULL").select("a", "b")
    if not large.isEmpty():
        pairs = pairs.unionByName(apart(large, about))
    rest = materialise(pairs.where("a <> b").distinct().join(nearest, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        roots = components(found.unionByName(sure(rest)))
    ids = of.select("doc_id").distinct()
    return ids.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, with all their columns, that are the first (smallest doc_id) of their group of near copies.

    Of rows that share a doc_id one stays; rows without a doc_id all stay.
    """
    groups = near_copy_groups(docs, shingle, similarity)
    gone = materialise(groups.where("component_id <> doc_id").select("doc_id"), "copies")
    kept = docs.join(gone, "doc_id", "left_anti").select(*map(column, docs.columns))
    unique = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()
    return kept if unique else kept.where("doc_id IS NULL").unionByName(kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))
