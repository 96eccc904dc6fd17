"""Removal of repeated passages: seeds, extension, maximal repeats.

A window is a run of ``window`` words. Of the hashes of its ``seed``-word
sequences it has a smallest one, the leftmost of equals: its anchor. Equal
windows have equal anchors at equal places, so documents need only meet at their
anchors (about one word in eight), not at every word. The consecutive windows
that share an anchor occurrence are its extent, the longest stretch to both
sides that this anchor answers for.

1. Occurrences whose whole extents are equal (anchor, extent and place in it)
   are copies: all but the first repeat it, with no look at single windows. Each
   batch settles its own copies before anything is shuffled, so an anchor that a
   third of the documents hold sends a row a batch, not a row a document.
2. The first occurrence of each extent whose anchor has other extents too is
   extended: its windows are compared with theirs, one by one, by hash.
3. The covered stretches of a document are united into maximal repeats and cut.

Words are hashed to 64 bits and windows meet by anchor, place and window hash,
which makes 128 bits; no pair of documents is ever written out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import grams, materialise, partitions, prepare, spans_hash, word_hashes

_NO_ID = np.iinfo(np.int64).max
#: Bits of the shape that hold an anchor's place in its first window, and the number of windows.
_PLACE = 10


def windowed_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest of each width consecutive values, by doubling."""
    n = len(x) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    best, at, have = x, np.arange(len(x)), 1
    while have < width:
        step = min(have, width - have)
        left, right = slice(0, len(best) - step), slice(step, None)
        take = best[right] < best[left]
        best, at = np.where(take, best[right], best[left]), np.where(take, at[right], at[left])
        have += step
    return at


def extents(words: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, its position, first window and number of windows, for every anchor occurrence of a text."""
    hashes = grams(words, seed)
    at = windowed_argmin(hashes, window - seed + 1)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else at
    count = np.diff(np.append(first, len(at)))
    return hashes[at[first]], at[first], first, count


def unite(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open intervals, as maximal ones in order."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], start[1:] > end[:-1]))
    return start[new], end[np.append(new[1:], True)]


def _firsts(keys: list[np.ndarray], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are the first (by document and start) of their key, and which have one that is strictly before them."""
    order = np.lexsort([start, doc, *keys[::-1]])
    new = np.zeros(len(order), dtype=bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    group = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    head = order[group]
    first, later = np.zeros(len(order), dtype=bool), np.zeros(len(order), dtype=bool)
    first[order] = new
    later[order] = (doc[order] != doc[head]) | (start[order] != start[head])
    return first, later


def _covered(doc: np.ndarray, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Maximal covered stretches by row; doc and text name the row."""
    order = np.lexsort([start, text, doc])
    doc, text, start, end = doc[order], text[order], start[order], end[order]
    if not len(doc):
        return doc, text, start, end
    row = np.cumsum(np.concatenate(([0], (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]))))
    wide = np.int64(1) << 40
    s, e = unite(start + row * wide, end + row * wide)
    at = np.searchsorted(row, s // wide)
    return doc[at], text[at], s % wide, (e - 1) % wide + 1


_ROWS = "key long, extent long, shape long, doc long, text long, start long, end long"


def _out(n: int, **columns: np.ndarray | None) -> pa.RecordBatch:
    names = ("key", "extent", "shape", "doc", "text", "start", "end")
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()) if columns.get(k) is None else pa.array(columns[k].astype(np.int64) if columns[k].dtype != np.uint64 else columns[k].view(np.int64)) for k in names], names=list(names))


def _settle(window: int, key: np.ndarray, extent: np.ndarray, shape: np.ndarray, doc: np.ndarray, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A batch's rows: covered stretches of what repeats a row of the batch (no extent), and the firsts."""
    if not len(key):
        return
    first, later = _firsts([key, extent, shape], doc, start)
    d, t, s, e = _covered(doc[later], text[later], start[later], end[later])
    if len(d):
        spread = grams(np.stack([d.view(np.uint64), s.astype(np.uint64)], axis=1).ravel(), 2)[::2]
        yield _out(len(d), key=spread, doc=d, text=t, start=s, end=e)
    yield _out(int(first.sum()), key=key[first], extent=extent[first], shape=shape[first], doc=doc[first], text=text[first], start=start[first], end=end[first])


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
    for doc, row, text in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), batch.column("text")):
        yield (_NO_ID if doc is None else doc), row, (text.as_py() or "").encode("utf-8", "surrogatepass")


def remove_repeats(docs: DataFrame, window: int = 20, seed: int = 6) -> DataFrame:
    """Cuts words that lie in a window which also starts earlier in docs (doc_id, text).

    Earlier means in a smaller doc_id, or in the same document further left; only
    the input counts, not what is left of it. Returns doc_id, n_words, n_removed,
    kept (the kept words joined by one blank) and repeats (the maximal repeats cut,
    as word ranges) for every row. Words are separated by blanks and 0x09 to 0x0D.

    Null and empty texts have no words. Rows that share a doc_id are told apart by
    their text; none of two equal starts is the earlier one, so repeated rows keep
    what no other doc_id has. A null doc_id comes last. Other columns aren't read.
    An empty table gives no rows.
    """
    if not 1 <= seed <= window < 1 << _PLACE // 2:
        raise ValueError("needs 1 <= seed <= window < 32")
    spark = docs.sparkSession
    prepare(spark)
    n = partitions(docs)
    rows = docs.select("doc_id", "text", F.shiftrightunsigned(F.xxhash64("text"), 24).alias("row"))

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for doc, row, text in _rows(batch):
                words = word_hashes(text)
                key, at, first, count = extents(words, window, seed)
                if len(key):
                    end = first + count - 1 + window
                    shape = ((at - first) << _PLACE // 2) + count
                    found.append((key, spans_hash(words, first, end), shape, np.full(len(key), doc), np.full(len(key), row), first, end))
            if found:
                yield from _settle(window, *(np.concatenate(x) for x in zip(*found)))

    same = Window.partitionBy("key", "extent", "shape")
    met = rows.mapInArrow(seeds, _ROWS).repartition(n, "key")
    ranked = met.withColumn("head", F.min(F.struct("doc", "start")).over(same)).withColumn("nth", F.row_number().over(same.orderBy("doc", "start")))
    ranked = ranked.withColumn("extents", F.count_if(F.col("nth") == 1).over(Window.partitionBy("key")))
    repeats = F.col("extent").isNull() | (F.col("head.doc") < F.col("doc")) | (F.col("head.start") < F.col("start"))
    judged = ranked.select("doc", "text", "start", "end", "key", "shape", repeats.alias("covered"), ((F.col("nth") == 1) & (F.col("extents") > 1) & F.col("extent").isNotNull()).alias("open"))
    settled = materialise(judged.where("covered or open"), "repeats")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for (doc, row, text), anchors in zip(_rows(batch), batch.column("anchors")):
                words = word_hashes(text)
                part = anchors.values
                key, shape, first = (part.field(k).to_numpy(zero_copy_only=False) for k in ("key", "shape", "start"))
                count = shape & ((1 << _PLACE // 2) - 1)
                start = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                place = np.repeat(first + (shape >> _PLACE // 2), count) - start
                found.append((np.repeat(key, count).view(np.uint64), grams(words, window)[start], place, np.full(len(start), doc), np.full(len(start), row), start, start + window))
            if found:
                yield from _settle(window, *(np.concatenate(x) for x in zip(*found)))

    opened = settled.where("open").groupBy("doc", "text").agg(F.collect_list(F.struct("key", "shape", "start")).alias("anchors"))
    id_of = F.coalesce("doc_id", F.lit(_NO_ID))
    keyed = rows.withColumns({"doc": id_of})
    windows = keyed.join(opened.withColumnRenamed("text", "row"), ["doc", "row"]).select("doc_id", "row", "text", "anchors").mapInArrow(extend, _ROWS).repartition(n, "key")
    earlier = windows.withColumn("head", F.min(F.struct("doc", "start")).over(same)).where(repeats)

    covered = settled.where("covered").select("doc", "text", "start", "end").unionByName(earlier.select("doc", "text", "start", "end"))
    cuts = covered.groupBy("doc", "text").agg(F.collect_list(F.struct("start", "end")).alias("cuts")).withColumnRenamed("text", "row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept, spans = [], [], [], []
            for (_, _, text), cuts in zip(_rows(batch), batch.column("cuts")):
                words = text.split()
                total.append(len(words))
                at, left, ranges = 0, [], []
                if cuts.is_valid:
                    s, e = unite(*(cuts.values.field(k).to_numpy(zero_copy_only=False) for k in ("start", "end")))
                    for x, y in zip(s.tolist(), e.tolist()):
                        left += words[at:x]
                        at = y
                        ranges.append({"start": x, "end": y})
                left += words[at:]
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
                spans.append(ranges)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["doc_id", "n_words", "n_removed", "kept", "repeats"])

    joined = keyed.join(cuts, ["doc", "row"], "left").select("doc_id", "row", "text", "cuts")
    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string, repeats array<struct<start: long, end: long>>")
