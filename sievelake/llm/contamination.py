"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so their resemblance is tiny even when
a document holds the whole item; what matters is containment, the share of the
item's shingles that the document has. Items are partitioned by the number q of
their distinct shingles, a partition from each power of two to the next. Within a
partition all sketches have one size: the k smallest shingle hashes, k being one
more than the shingles that its largest item may lack. The sketch of a document
for a partition are its hashes up to the largest one that any sketch of the
partition holds. Of a document that has ceil(threshold * q) of an item's shingles, at
most k - 1 can be missing, so at least one hash of the item's sketch is in the
document's, and the search misses nothing.

Sketches of both sides meet in a join on partition and hash. A Bloom filter of the
items' sketches, of a bounded size, keeps what can't meet from being shuffled; it never
says no to what can. The one scan of the documents writes the texts of those that
passed it, and the pairs that met are verified on the shingles themselves. Neither
items nor sketches come to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, grams, materialise, mix, prepare, released, unused, word_hashes

#: Probes of the Bloom filter, and the powers of two that its bits are at least and at most; in between 64 bits a hash.
PROBES, FILTER_BITS = 4, (16, 30)
#: Groups that the candidates of one document are verified in at most.
GROUPS = 16
_MARKS = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))


def normalise(text: str | None) -> bytes:
    """Small letters, with every ASCII sign that is neither letter nor digit as a blank."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_MARKS)


def shingles(words: list[bytes], n: int) -> set[bytes]:
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}


def hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of all shingles of n words; other ones for each n."""
    return np.unique(mix(grams(words, n) + np.uint64(n)))


def sketch_size(part: int, threshold: float) -> int:
    """Hashes of an item of at least 2 ** (part - 1) and less than 2 ** part shingles."""
    return math.floor((1 - threshold) * (2**part - 1) + 1e-9) + 1


def slots(keys: np.ndarray, part: int, bits: int) -> np.ndarray:
    """Places in the filter, a row a probe."""
    salt = mix(np.arange(PROBES, dtype=np.uint64) + np.uint64(part << 8))
    return mix(keys[None, :] ^ salt[:, None]) >> np.uint64(64 - bits)


def _sketched(items: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """row, item_id, text, n (words of a shingle), part and sketch of every item that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                words = word_hashes(normalise(text))
                if n := min(shingle, len(words)):
                    own = hashes(words, n)
                    part = len(own).bit_length()
                    rows.append((item, text, n, part, own[: sketch_size(part, threshold)].view(np.int64).tolist()))
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=["item_id", "text", "n", "part", "sketch"])

    found = items.select("item_id", "text").mapInArrow(run, "item_id long, text string, n int, part int, sketch array<long>")
    return materialise(found.withColumn("item", F.monotonically_increasing_id()), "items")


def _filter(sketches: DataFrame, bits: int) -> np.ndarray:
    """The bits of the items' sketches (part, hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, keys = batch.column("part").to_numpy(), batch.column("hash").to_numpy().view(np.uint64)
            at = np.concatenate([slots(keys[part == p], int(p), bits).ravel() for p in np.unique(part)] or [np.zeros(0, dtype=np.uint64)])
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["at", "word"])

    words = sketches.mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[words.column("at").to_numpy()] = words.column("word").to_numpy().view(np.uint64)
    return out


def _pairs(docs: DataFrame, items: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """doc_id, text, item_id, n_shingles and n_shared of every row of docs and item that it contains."""
    found = _sketched(items, shingle, threshold)
    sketches = found.select("item", "n", "part", F.explode("sketch").alias("hash"))
    low, high = FILTER_BITS
    bits = min(high, max(low, (64 * sketches.count()).bit_length()))
    bloom = _filter(sketches.select("part", "hash"), bits)
    # a row for each length of shingles and power of two
    unsigned = F.col("hash").bitwiseXOR(F.lit(-(1 << 63)))
    tops = [(r.n, r.part, np.uint64(r.top + (1 << 63))) for r in sketches.groupBy("n", "part").agg(F.max(unsigned).alias("top")).orderBy("n", "part").collect()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words, n, own = word_hashes(normalise(text.as_py())), 0, None
                row, met = row + 1, []
                for size, part, top in tops:
                    if size != n:
                        n, own = size, hashes(words, size)
                    some = own[: np.searchsorted(own, top, side="right")]
                    if len(some):
                        at = slots(some, part, bits)
                        some = some[((bloom[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0)]
                    met += [{"part": part, "hash": h} for h in some.view(np.int64).tolist()]
                if met:
                    out.append((row, doc, text.as_py(), met))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("part", pa.int32()), ("hash", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 4, kinds)], names=["row", "doc_id", "text", "met"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, items in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("items").to_pylist()):
                words, mine = normalise(text).split(), {}
                for item in items:
                    n = item["n"]
                    theirs = shingles(normalise(item["text"]).split(), n)
                    if n not in mine:
                        mine[n] = shingles(words, n)
                    shared = len(theirs & mine[n])
                    if shared >= math.ceil(threshold * len(theirs) - 1e-9):
                        out.append((doc, text, item["item_id"], len(theirs), shared))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)], names=["doc_id", "text", "item_id", "n_shingles", "n_shared"])

    scanned = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(scan), "row long, doc_id long, text string, met array<struct<part: int, hash: long>>")
    passed = materialise(scanned, "passed")
    met = passed.select("row", F.explode("met").alias("m")).select("row", "m.part", "m.hash").join(sketches.select("item", "part", "hash"), ["part", "hash"]).select("row", "item").distinct()
    about = F.struct("item_id", "n", F.col("text").alias("text"))
    lists = met.join(found, "item").groupBy("row", F.pmod("item", F.lit(GROUPS)).alias("group")).agg(F.collect_list(about).alias("items"))
    return passed.select("row", "doc_id", "text").join(lists, "row").select("doc_id", "text", "items").mapInArrow(verify, "doc_id long, text string, item_id long, n_shingles long, n_shared long")


def contained_items(docs: DataFrame, items: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """Pairs of documents (doc_id, text) and items (item_id, text) with containment >= threshold.

    Returns doc_id, item_id, n_shingles (distinct ones of the item), n_shared and
    containment. Shingles are word sequences of normalised texts; an item with
    fewer words than a shingle has one, the whole, and one without words is in no
    document. Null and empty documents contain nothing. A repeated row pairs as
    often as it comes; equal items pair each. Other columns aren't read. Empty
    tables give no rows. Documents are scanned once, however many items there are.
    """
    prepare(docs.sparkSession)
    pairs = _pairs(docs, items, shingle, threshold)
    return pairs.select("doc_id", "item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """The documents, with all their columns, that contain no item; each row is kept or dropped by its own text, by the rules of contained_items."""
    prepare(docs.sparkSession)
    one, two = unused(docs, "one"), unused(docs, "two")

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumns({one: F.xxhash64("text"), two: F.xxhash64(F.lit(one), "text")})

    bad = materialise(keyed(_pairs(docs.select(F.lit(None).cast("long").alias("doc_id"), "text"), items, shingle, threshold)).select(one, two).distinct(), "contaminated")
    return keyed(docs).join(bad, [one, two], "left_anti").select(*map(column, docs.columns))
