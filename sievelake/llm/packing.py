"""Best-fit packing by sums of squares.

Documents become fixed-length training sequences. Pieces as long as a sequence
fill one each; every shorter piece goes where the sum of N(g)**2 over the gaps g
of the open sequences, N(g) of which have g places left, becomes smallest. That
keeps the gaps varied, so that later pieces find a gap they fill. A new sequence
is opened only if no gap is large enough; the rule in which opening one is a
choice like any other (``opening``) needs more sequences.

The documents are dealt out in blocks of a bounded number by a hash of their place
in the input, so that neither a hot key nor a large table gathers in one task.
A task holds one block, which is packed by itself, longest pieces first; that
wastes a few sequences a block.

Null and empty texts are documents of one end token. Repeated rows and ties
are documents of their own. Columns other than doc_id and text aren't read. An
empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, prepare, released
from .tokens import bpe

#: Documents that are packed together, on average; a task holds one such block.
BLOCK = 1 << 16


def pack(lengths: np.ndarray, capacity: int, opening: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; all lengths from 1 to the capacity.

    A piece of length s takes the gap g >= s with the smallest change of the sum
    of squares: 2 * (N(g - s) - N(g) + 1), or 1 - 2 * N(s) if it fills the gap, as
    full sequences don't count. Ties go to the smallest gap. A new sequence is
    opened only when no gap is large enough, or, with ``opening``, also if that
    changes the sum by less: 2 * N(capacity - s) + 1.
    """
    sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    never = np.int64(1) << 60
    gain = np.zeros(capacity + 1, dtype=np.int64)  # 2 * N(g), and for the full ones what makes the change odd
    gain[0] = -1
    loss = np.full(capacity + 1, never)  # 2 - 2 * N(g), or never if there is no such gap
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    opened = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        change = gain[: capacity + 1 - s] + loss[s:]
        best = int(change.argmin())
        if change[best] >= never // 2 or opening and s < capacity and gain[capacity - s] + 1 < change[best]:
            gap, at = capacity, opened
            opened += 1
        else:
            gap = best + s
            at = bins[gap].pop()
            n = len(bins[gap])
            gain[gap], loss[gap] = 2 * n, 2 - 2 * n if n else never
        sequence[i], offset[i] = at, capacity - gap
        if left := gap - s:
            bins[left].append(at)
            n = len(bins[left])
            gain[left], loss[left] = 2 * n, 2 - 2 * n
    return sequence, offset


def tokenised(docs: DataFrame, vocab: str, capacity: int, end: int, blocks: int, plain: bool) -> DataFrame:
    """One row per document: doc_id, n_tokens, the CRC-32 of each piece, and its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, row, encoder = TaskContext.get().partitionId(), 0, bpe(vocab, plain)
        for batch in batches:
            ids, crcs = [], []
            for text in batch.column("text"):
                a = np.append(encoder.ids(text.as_py() or ""), np.uint32(end)).astype("<u4")
                first = (len(a) - 1) % capacity + 1
                cuts = [0, *range(first, len(a) + 1, capacity)]
                raw = a.tobytes()
                ids.append(len(a))
                crcs.append([zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(cuts, cuts[1:])])
            n = batch.num_rows
            place = mix(np.arange(row, row + n, dtype=np.uint64) + (np.uint64(task) << np.uint64(32))) % np.uint64(blocks)
            row += n
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(ids, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(place.astype(np.int32))], names=["doc_id", "n_tokens", "crcs", "block"])

    return docs.select("doc_id", "text").mapInArrow(released(run), "doc_id long, n_tokens long, crcs array<long>, block int")


def best_fit_packing(docs: DataFrame, vocab: str, capacity: int = 1024, end: int = 2, block: int = BLOCK, plain: bool = False) -> DataFrame:
    """Packs documents (doc_id, text) into sequences of at most capacity tokens.

    A document is the ids of its text, as the tokenizers library gives them, and the
    end id; ``plain`` takes the strings of added tokens as ordinary text. One that is longer than a
    sequence is cut: the first piece takes the rest, all others are full. Returns
    per piece doc_id, piece, start, length, ids_crc32, sequence_id, offset; offsets
    of a sequence run from 0 without gaps.
    """
    prepare(docs.sparkSession)
    blocks = max(1, -(-docs.count() // block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = [b for b in batches if b.num_rows]
        if not gathered:
            return
        table = pa.Table.from_batches(gathered)
        which = table.column("block").to_numpy()
        for one in np.unique(which).tolist():
            part = table.filter(pa.array(which == one)).combine_chunks()
            doc = part.column("doc_id").combine_chunks()
            n = part.column("n_tokens").to_numpy()
            pieces = -(-n // capacity)
            first = (n - 1) % capacity + 1
            owner = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = np.where(piece == 0, 0, first[owner] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[owner], capacity)
            sequence, offset = np.zeros(len(owner), dtype=np.int64), np.zeros(len(owner), dtype=np.int64)
            full = length == capacity
            sequence[full] = np.arange(full.sum())
            sequence[~full], offset[~full] = pack(length[~full], capacity)
            sequence[~full] += full.sum()
            out = pa.RecordBatch.from_arrays(
                [doc.take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), part.column("crcs").combine_chunks().flatten(), pa.array(sequence + (np.int64(one) << 40)), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )
            for at in range(0, out.num_rows, 50_000):
                yield out.slice(at, 50_000)

    dealt = tokenised(docs, vocab, capacity, end, blocks, plain).repartitionById(blocks, "block")
    return dealt.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
