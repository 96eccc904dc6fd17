"""Training-order materialisation of token sequences.

The documents of an input split, each closed by an end id, follow each other and
are cut every ``length`` ids; only the last sequence of a split is padded. All
sequences are numbered, by split and place; a keyed Feistel permutation, walked
along its cycle until it falls within the number of sequences, gives each number a
global slot, so the order of training is random, reproducible from the key, and
computed for each row alone. A shard is a range of slots; its file holds one
record of a fixed stride a slot. So a reader that is told a slot knows the file
and the byte, reads sequentially from there, and resumes anywhere.

Texts are tokenised once: the sequences are written to the shared folder with
their place in their split, and numbered when the sequences of every split are
known. A shard is written under a name of its attempt and then renamed, so a task
that is run again, or twice at once, leaves the same file. The manifest comes last:
a folder with a manifest has all its shards.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, mix, prepare
from .tokens import bpe

#: Rounds of the Feistel network.
ROUNDS = 6
#: Sequences of an Arrow batch.
_BATCH = 2048
_PARTS = "parts array<struct<doc_id: long, piece: int, start: long, n_ids: int>>"


def permute(x: np.ndarray, size: int, key: int) -> np.ndarray:
    """A keyed permutation of 0 .. size - 1, for many numbers at once.

    The network permutes the numbers of an even number of bits, fewer than four
    times the size; what falls beyond the size is permuted again until it doesn't.
    """
    half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(key * 0x9E3779B97F4A7C15 % (1 << 64)))
    out = np.asarray(x, dtype=np.uint64).copy()
    walk = np.arange(len(out))
    while len(walk):
        v = out[walk]
        left, right = v >> np.uint64(half), v & low
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & low)
        v = (left << np.uint64(half)) | right
        out[walk] = v
        walk = walk[v >= np.uint64(size)]
    return out.astype(np.int64)


class _Stream:
    """Cuts a stream of documents into sequences; holds what hasn't filled one yet."""

    def __init__(self, length: int) -> None:
        self.length, self.number = length, 0
        self.left: list[tuple[int | None, int, int, np.ndarray]] = []  # doc_id, piece, start, ids

    def add(self, docs: list[tuple[int | None, int, int, np.ndarray]], last: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, list[int | None], np.ndarray, np.ndarray, np.ndarray]]:
        """Ids of all sequences that are full (or left, at last), where they end, and doc_id, piece, start and length of their parts with the sequence that each is of."""
        docs = self.left + docs
        if not docs:
            return
        flat = np.concatenate([x[3] for x in docs])
        ends = np.cumsum([len(x[3]) for x in docs])
        begins = np.concatenate(([0], ends[:-1]))
        at = np.union1d(begins, np.arange(0, len(flat), self.length))
        size = np.diff(np.append(at, len(flat)))
        owner = np.searchsorted(ends, at, side="right")
        first = np.searchsorted(at, begins)
        piece = np.array([x[1] for x in docs])[owner] + np.arange(len(at)) - first[owner]
        start = np.array([x[2] for x in docs])[owner] + at - begins[owner]
        n = -(-len(flat) // self.length) if last else len(flat) // self.length
        parts = int(np.searchsorted(at, n * self.length))
        self.left = [(docs[o][0], int(p), int(s), flat[a : a + k]) for o, p, s, a, k in zip(owner[parts:], piece[parts:], start[parts:], at[parts:], size[parts:])]
        for i in range(0, n, _BATCH):
            j = min(n, i + _BATCH)
            lo, hi = np.searchsorted(at, [i * self.length, j * self.length])
            bounds = np.minimum(np.arange(i, j + 1) * self.length, len(flat))
            own = slice(lo, hi)
            yield flat[bounds[0] : bounds[-1]], bounds - bounds[0], [docs[o][0] for o in owner[own]], piece[own], start[own], np.stack([size[own], at[own] // self.length - i])


def materialise_order(docs: DataFrame, vocab: str, out: str, length: int = 1024, per_shard: int = 16_384, key: int = 20_240_601, end: int = 50_256, pad: int = 50_256, width: str = "<u2") -> DataFrame:
    """Writes the sequences of docs (doc_id, text) in training order to the folder ``out`` (a URI that all executors reach).

    File ``shard-NNNNNNNN.bin`` holds the slots from N * per_shard on, each as
    ``length`` ids of type ``width``; ``manifest.json`` says so once all are there.
    Returns for each part of a document that a sequence holds doc_id, piece (from 0),
    start (the document's ids before it), n_ids, slot, shard, byte_offset (in the
    shard's file) and crc32 (of its ids as written). The shards are written when this
    returns; using the result doesn't write them again.

    Strings of added tokens in a text are ordinary text, so that only ``end`` ends a
    document. Null and empty texts are the end id alone. Repeated rows are documents
    of their own; doc_id may be anything. Other columns aren't read. An empty table
    gives no rows and no shards.
    """
    spark = docs.sparkSession
    prepare(spark)
    kind = np.dtype(width)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, stream, encoder = TaskContext.get().partitionId(), _Stream(length), bpe(vocab, plain=True)

        def rows(found: list[tuple[int | None, int, int, np.ndarray]], last: bool = False) -> Iterator[pa.RecordBatch]:
            for flat, bounds, doc, piece, start, (size, of) in stream.add(found, last):
                n = len(bounds) - 1
                raw, width = flat.tobytes(), kind.itemsize
                ids = [raw[a * width : b * width] for a, b in zip(bounds, bounds[1:])]
                parts = pa.StructArray.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int32())], names=["doc_id", "piece", "start", "n_ids"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), parts)
                yield pa.RecordBatch.from_arrays([pa.array([split] * n, pa.int64()), pa.array(np.arange(stream.number, stream.number + n), pa.int64()), pa.array(ids, pa.binary()), lists], names=["split", "number", "ids", "parts"])
                stream.number += n

        for batch in batches:
            found = []
            for doc, text in zip(batch.column("doc_id").cast(pa.int64()).to_pylist(), batch.column("text")):
                ids = np.append(encoder.ids(text.as_py() or ""), np.uint32(end))
                if int(ids.max()) > np.iinfo(kind).max:
                    raise ValueError(f"an id does not fit {width}")
                found.append((doc, 0, 0, ids.astype(kind)))
            yield from rows(found)
        yield from rows([], last=True)

    sequences = materialise(docs.select("doc_id", "text").mapInArrow(tokenise, f"split long, number long, ids binary, {_PARTS}"), "sequences", zstd=9)
    counts = sequences.groupBy("split").agg((F.max("number") + 1).alias("n")).orderBy("split").toArrow()  # a row an input split
    splits, sizes = counts.column("split").to_numpy(), counts.column("n").to_numpy()
    first, total = np.cumsum(sizes) - sizes, int(sizes.sum())
    shards = -(-total // per_shard)
    place, name = fs.FileSystem.from_uri(out)
    place.create_dir(name, recursive=True)
    for old in place.get_file_info(fs.FileSelector(name)):
        if old.base_name == "manifest.json":
            place.delete_file(old.path)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            at = first[np.searchsorted(splits, batch.column("split").to_numpy())] + batch.column("number").to_numpy()
            slot = permute(at, total, key)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array((slot // per_shard).astype(np.int32)), pa.array([squeeze(x.as_py()) for x in batch.column("ids")], pa.binary()), batch.column("parts")], names=["slot", "shard", "ids", "parts"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, name = fs.FileSystem.from_uri(out)
        expand = zstandard.ZstdDecompressor().decompress
        shard, stream, temporary, due = -1, None, "", 0

        def close() -> None:
            if stream is not None:
                stream.close()
                if due != min((shard + 1) * per_shard, total):
                    raise RuntimeError(f"shard {shard} ends at slot {due}")
                place.move(temporary, f"{name}/shard-{shard:08d}.bin")

        for batch in batches:
            lists = batch.column("parts")
            held = np.diff(lists.offsets.to_numpy())
            parts = lists.flatten()
            size = parts.field("n_ids").to_numpy().astype(np.int64)
            slots = batch.column("slot").to_numpy()
            before = np.cumsum(size) - size
            begin = np.cumsum(held) - held  # every sequence has a part
            offset = (before - np.repeat(before[begin], held) if len(held) else before) * kind.itemsize
            ends, crcs, k = (offset + size * kind.itemsize).tolist(), [], 0
            starts = offset.tolist()
            for slot, s, ids, n in zip(slots.tolist(), batch.column("shard").to_pylist(), batch.column("ids"), held.tolist()):
                if s != shard:
                    close()
                    shard, due, temporary = s, s * per_shard, f"{name}/_{s:08d}-{uuid.uuid4().hex}"
                    stream = place.open_output_stream(temporary)
                if slot != due:
                    raise RuntimeError(f"slot {due} is missing")
                raw = expand(ids.as_py())
                crcs += [zlib.crc32(raw[starts[i] : ends[i]]) for i in range(k, k + n)]
                k += n
                stream.write(raw if len(raw) == length * kind.itemsize else raw + np.full(length - len(raw) // kind.itemsize, pad, dtype=kind).tobytes())
                due += 1
            own = np.repeat(slots, held)
            yield pa.RecordBatch.from_arrays(
                [*(parts.field(x) for x in ("doc_id", "piece", "start", "n_ids")), pa.array(own), pa.array(own // per_shard), pa.array(own % per_shard * (length * kind.itemsize) + offset), pa.array(crcs, pa.int64())],
                names=["doc_id", "piece", "start", "n_ids", "slot", "shard", "byte_offset", "crc32"],
            )
        close()

    numbered = sequences.mapInArrow(number, f"slot long, shard int, ids binary, {_PARTS}")
    dealt = numbered.repartitionById(max(1, shards), "shard").sortWithinPartitions("slot")
    index = materialise(dealt.mapInArrow(write, "doc_id long, piece int, start long, n_ids int, slot long, shard long, byte_offset long, crc32 long"), "order")
    for left in place.get_file_info(fs.FileSelector(name)):
        if left.base_name.startswith("_"):  # of attempts that failed
            place.delete_file(left.path)
    about = {"sequences": total, "length": length, "type": width, "stride": length * kind.itemsize, "per_shard": per_shard, "shards": shards, "key": key}
    with place.open_output_stream(f"{name}/manifest.json") as f:
        f.write(json.dumps(about).encode())
    discard(sequences)
    return index


def read_slots(out: str, start: int, n: int) -> np.ndarray:
    """n sequences from a slot on, read sequentially from the shards; fewer at the end."""
    place, name = fs.FileSystem.from_uri(out)
    with place.open_input_stream(f"{name}/manifest.json") as f:
        about = json.loads(f.read())
    rows, kind = [], np.dtype(about["type"])
    while n > 0 and start < about["sequences"]:
        shard, skip = divmod(start, about["per_shard"])
        some = min(n, about["per_shard"] - skip, about["sequences"] - start)
        with place.open_input_file(f"{name}/shard-{shard:08d}.bin") as f:
            f.seek(skip * about["stride"])
            rows.append(np.frombuffer(f.read(some * about["stride"]), dtype=kind).reshape(some, about["length"]))
        start, n = start + some, n - some
    return np.concatenate(rows) if rows else np.zeros((0, about["length"]), dtype=kind)
