"""Matches over whole columns of texts, by RE2 in pyarrow and sums over bytes.

As in spans, a finding is marked where it stands; but all texts of a batch are one run
of bytes, in which the places of marks, less the marks before them, are the places of
findings. Nothing is done text by text or finding by finding.

This holds for plain texts: ASCII without the mark and without vertical tabs, which to
Java, but not to RE2, are blanks. In them the patterns of the catalog find the same in
both engines (words end and letters match regardless of case as in ASCII); nothing is
known of other patterns, so these are for spans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .catalog import VARIANTS, Pattern, detectors, labelled, names
from .spans import two_groups

_MARK = 1
#: What a text that isn't plain has, as Java writes it.
NOT_PLAIN = r"[^\x02-\x0A\x0C-\x7F]"
#: Bytes of texts that are looked through in one go, and of words that are given back in one batch; a longer one is alone.
PART, WORDS = 1 << 18, 1 << 26


@cache
def _known() -> frozenset[tuple[str, int]]:
    every = [p for v in VARIANTS for profile in ("intended", "as_written") for p in detectors(v, profile) + labelled(v, profile)] + names()
    return frozenset((p.regex, p.group) for p in every)


def of_catalog(patterns: list[Pattern]) -> bool:
    """Whether all patterns are such as the catalog has."""
    return all((p.regex, p.group) in _known() for p in patterns)


def finder(patterns: list[Pattern]) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    """A function from batches to their findings, by row, pattern, then place.

    A batch has columns to keep, then plain texts (or null), then what spans found in
    texts that aren't plain (or null). Of each finding the batches that come back have
    the columns to keep, then its pattern's place in the list, its place in its row's
    findings, word, start and end.

    It is a function with all it needs, so that workers needn't import this package.
    """
    part_bytes, word_bytes, mark, n_patterns = PART, WORDS, _MARK, len(patterns)
    ranks: dict[tuple[str, int], list[int]] = {}
    for rank, p in enumerate(patterns):
        ranks.setdefault((p.regex, p.group), []).append(rank)
    jobs = [(two_groups(regex), r"\1%c\2%c" % (mark, mark), at) if group else (regex, r"%c\0%c" % (mark, mark), at) for (regex, group), at in ranks.items()]
    kinds = pa.array([f"{p.category} {p.method}" for p in patterns])

    def body(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of texts without nulls, and where each begins in them."""
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.intp) if len(texts) else np.zeros(1, np.intp)
        some = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
        return some, at - at[0]

    def before(counts: np.ndarray) -> np.ndarray:
        return np.cumsum(counts) - counts

    def words(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum(size)])
        taken = data[np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], size)]
        return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(taken))

    def found(kept: list[pa.Array], row: np.ndarray, *columns: pa.Array | np.ndarray) -> pa.RecordBatch:
        rows = pa.array(row)
        arrays = [x.take(rows) for x in kept] + [x if isinstance(x, pa.Array) else pa.array(x.astype(np.int32)) for x in columns]
        return pa.RecordBatch.from_arrays(arrays, names=[f"_{i}" for i in range(len(arrays))])

    def in_plain(kept: list[pa.Array], texts: pa.Array) -> Iterator[pa.RecordBatch]:
        data, at = body(texts)
        counts, places = np.zeros((len(texts), n_patterns), np.intp), []
        for regex, marked, of in jobs:
            changed, ends = body(pc.replace_substring_regex(texts, pattern=regex, replacement=marked))
            marks = np.flatnonzero(changed == mark)
            counts[:, of] = ((np.diff(ends) - np.diff(at)) // 2)[:, None]
            places.append(marks - np.arange(len(marks)))
        slot, per_row = before(counts.ravel()).reshape(counts.shape), counts.sum(1)
        begin, size = np.empty(per_row.sum(), np.intp), np.empty(per_row.sum(), np.intp)
        for (_, _, of), place in zip(jobs, places):
            n = counts[:, of[0]]
            for rank in of:
                to = np.arange(len(place) // 2) + np.repeat(slot[:, rank] - before(n), n)
                begin[to], size[to] = place[::2], place[1::2] - place[::2]
        row = np.repeat(np.arange(len(texts)), per_row)
        which = np.repeat(np.tile(np.arange(n_patterns), len(texts)), counts.ravel())
        seq, start = np.arange(len(row)) - np.repeat(before(per_row), per_row), begin - at[row]
        total = np.cumsum(size)
        cuts = np.unique(np.searchsorted(total, np.arange(0, total[-1] if len(total) else 0, word_bytes)))
        for i, j in zip(cuts, [*cuts[1:], len(row)]):
            yield found(kept, row[i:j], which[i:j], seq[i:j], words(data, begin[i:j], size[i:j]), start[i:j], start[i:j] + size[i:j])

    def in_others(kept: list[pa.Array], others: pa.Array) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(others.is_valid().to_numpy(zero_copy_only=False))
        some = others.take(pa.array(at))
        n = pc.list_value_length(some).to_numpy(zero_copy_only=False).astype(np.intp)
        category, word, start, end, _, method = some.flatten().flatten()
        which = pc.index_in(pc.binary_join_element_wise(category, method, " "), value_set=kinds)
        yield found(kept, np.repeat(at, n), which, pa.array((np.arange(n.sum()) - np.repeat(before(n), n)).astype(np.int32)), word, start, end)

    def find(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        *kept, texts, others = batch.columns
        texts = texts.fill_null("")
        ends = body(texts)[1][1:]
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + part_bytes, "right")))
            yield from in_plain([x.slice(lo, hi - lo) for x in kept], texts.slice(lo, hi - lo))
            lo = hi
        if others.null_count < len(others):
            yield from in_others(kept, others)

    return find
