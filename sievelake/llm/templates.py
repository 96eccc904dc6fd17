"""Line dedup by log templates.

Lines are parsed by a tree of fixed depth: the number of tokens, then the leading
tokens that aren't variable, with their places. At a leaf, lines that agree in
enough tokens are one template, whose other fields are variable; tokens with digits
or at signs are variable from the start. A template that enough documents hold
recurs; its lines are dropped everywhere. Equal texts count as one document.

With ``apart``, documents count only if their other lines differ, too: what recurs
with its surroundings is then a copied document, which is left to document dedup.
The surroundings of a line are min-hashes of the document's other lines. Documents
whose surroundings agree in SAME of SLOTS min-hashes count as one, however many they
are and whatever part of them is boilerplate below about four fifths. Only as many
different surroundings as are asked for are kept.

Passes over the documents: count documents by leaf; parse the lines of leaves that
can hold a recurring template; drop lines. Each batch sums its own rows before they
are shuffled, and only the distinct lines of a leaf meet in one task, so a very
common line is one row there.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .common import column, grams, located_words, map_rows, materialise, mix, partitions, prepare, released, unused

#: Leading tokens of the tree, and tokens that a line needs at least.
DEPTH, TOKENS = 3, 1
#: Rows that a task sums before it sends them on.
SUMMED = 50_000
#: Leaves or lines that are sent to all tasks; more of them are joined instead.
SENT = 1_000_000
#: Min-hashes of a line's surroundings, a byte of each, and how many agree in copies: 25.6 are expected at a similarity of 0.8, 19 where shared lines make up three quarters.
SLOTS, SAME = 32, 23
VARIABLE = "<*>"
_FACTORS, _TERMS = mix(np.arange(1, SLOTS + 1, dtype=np.uint64)) | np.uint64(1), mix(np.arange(SLOTS + 1, 2 * SLOTS + 1, dtype=np.uint64))
_FIELD = re.compile(r"\S*[\d@]\S*")
_HAS_FIELD = re.compile(r"[\d@]")


def mask(line: str) -> str:
    """A line's tokens joined by single blanks, tokens with digits or at signs as variable fields."""
    return " ".join((_FIELD.sub(VARIABLE, line) if _HAS_FIELD.search(line) else line).split())


def parse(line: str, depth: int, tokens: int) -> tuple[int, int, str] | None:
    """The leaf, the hash and the masked text of a line; None if it has too few tokens, or variable ones only."""
    masked = mask(line)
    every = masked.split(" ")
    if not masked or len(every) < tokens:
        return None
    lead = [(i, x) for i, x in enumerate(every) if x != VARIABLE][:depth] if VARIABLE in masked else list(enumerate(every[:depth]))
    if not lead:
        return None
    return _hash(f"{len(every)} {lead}"), _hash(masked), masked


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def sketches(text: str) -> np.ndarray:
    """For each line of a text, a byte of each of SLOTS min-hashes of three words within another line."""
    raw = text.encode("utf-8", "surrogatepass")
    breaks = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 10)
    places, words = located_words(raw)
    least = np.full((len(breaks) + 3, SLOTS), np.iinfo(np.uint32).max, dtype=np.uint32)
    if len(words) > 2:
        line = np.searchsorted(breaks, places)
        inside = line[2:] == line[:-2]
        found, of = mix(grams(words, 3))[inside], line[:-2][inside] + 1
        for at in range(0, len(found), 1 << 12):
            values, some = ((found[at : at + (1 << 12), None] * _FACTORS + _TERMS) >> np.uint64(32)).astype(np.uint32), of[at : at + (1 << 12)]
            first = np.flatnonzero(np.concatenate(([True], some[1:] != some[:-1])))
            least[some[first]] = np.minimum(least[some[first]], np.minimum.reduceat(values, first))
    before, after = np.minimum.accumulate(least), np.minimum.accumulate(least[::-1])[::-1]
    return np.minimum(before[:-2], after[2:]).astype(np.uint8)


def different(rows: np.ndarray, most: int, known: np.ndarray) -> np.ndarray:
    """``known`` and the rows that agree in SAME slots with none of these or of the rows taken before, ``most`` at most."""
    for k in known:
        rows = rows[(rows == k).sum(axis=1) < SAME]
    taken = list(known)
    while len(rows) and len(taken) < most:
        taken.append(rows[0])
        rows = rows[(rows == rows[0]).sum(axis=1) < SAME]
    return np.array(taken, dtype=np.uint8).reshape(-1, SLOTS)


def _sums(batches: Iterator[pa.RecordBatch], depth: int, tokens: int, apart: bool, leaves: np.ndarray | None, texts: bool) -> Iterator[pa.RecordBatch]:
    """Documents by leaf and what tells them apart, summed as far as memory is meant for it; or by line, too, and each line's text once, of the leaves given, if any are."""
    wanted = None if leaves is None else set(leaves.tolist())
    total: Counter[tuple] = Counter()

    def out() -> pa.RecordBatch:
        columns = list(zip(*total)) if total else [[]] * (4 if texts else 2)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary()) if texts else (pa.int64(), pa.int64())
        names = ["leaf", "line", "masked", "around"] if texts else ["leaf", "around"]
        docs = pa.array(list(total.values()), pa.int64())
        total.clear()
        return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds)), docs], names=[*names, "docs"])

    for batch in batches:
        for t in batch.column("text"):
            text = t.as_py() or ""
            parsed = [(i, p) for i, line in enumerate(text.split("\n")) if (p := parse(line, depth, tokens)) and (wanted is None or p[0] in wanted)]
            if not parsed:
                continue
            if apart:
                around = [x.tobytes() for x in sketches(text)]
            else:
                around = [xxhash.xxh64_digest(text.encode("utf-8", "surrogatepass"))] * (parsed[-1][0] + 1)
            if texts:
                total.update({(*p[:2], None, around[i]) for i, p in parsed})
                total.update({(*p, None) for _, p in parsed})
            else:
                total.update({(p[0], xxhash.xxh64_intdigest(around[i]) - (1 << 63)) for i, p in parsed})
            if len(total) >= SUMMED:
                yield out()
    yield out()


class Leaf:
    """The templates of one leaf; its distinct lines come in order, with repeats.

    A line joins the template that it agrees with in most tokens, the earliest of
    equals, if that is at least the share ``similar`` of them; fields that differ
    become variable. Else it begins a template, named by its hash.

    Templates are listed by place and token. One that a line may join differs from
    it in ``spare`` places at most, so it is in one of any spare + 1 of the line's
    lists; the shortest are read. Lists aren't shortened when a field becomes
    variable, which only adds templates to compare with.
    """

    def __init__(self, similar: float) -> None:
        self.similar = similar
        self.templates: list[list[str]] = []
        self.names: list[int] = []
        self.listed: list[dict[str, list[int]]] = []
        self.last: tuple[str, int] | None = None

    def template(self, masked: str) -> int:
        if self.last and self.last[0] == masked:
            return self.last[1]
        tokens = list(map(sys.intern, masked.split(" ")))
        while len(self.listed) < len(tokens):
            self.listed.append({})
        best, agreed = -1, self.similar * len(tokens) - 1e-9
        spare = len(tokens) - math.ceil(agreed)
        lists = sorted((d.get(t, []) for d, t in zip(self.listed, tokens)), key=len)[: spare + 1]
        for i in sorted(set().union(*lists)) if spare < len(tokens) else range(len(self.templates)):
            n = sum(map(str.__eq__, self.templates[i], tokens))
            if n >= agreed and (best < 0 or n > agreed):
                best, agreed = i, n
        name = _hash(masked) if best < 0 else self.names[best]
        if best >= 0:
            now = self.templates[best]
            for k, (x, y) in enumerate(zip(now, tokens)):
                if x != y and x != VARIABLE:
                    now[k] = VARIABLE
                    self.listed[k].setdefault(VARIABLE, []).append(best)
        else:
            for k, t in enumerate(tokens):
                self.listed[k].setdefault(t, []).append(len(self.templates))
            self.templates.append(tokens)
            self.names.append(name)
        self.last = (masked, name)
        return name


def recurring_lines(docs: DataFrame, min_docs: int, similar: float, depth: int = DEPTH, tokens: int = TOKENS, apart: bool = False) -> DataFrame:
    """line (hash of a masked line), template and n_docs of the lines of recurring templates of docs (text)."""
    spark = docs.sparkSession
    n = partitions(docs)
    texts = docs.select("text")
    by_leaf = texts.mapInArrow(released(lambda b: _sums(b, depth, tokens, apart, None, False)), "leaf long, around long, docs long")
    leaves = materialise(by_leaf.groupBy("leaf", "around").agg(F.sum("docs").alias("docs")).groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("leaf"), "leaves")
    few = np.sort(leaves.toArrow().column("leaf").to_numpy()) if leaves.count() <= SENT else None
    lines = texts.mapInArrow(released(lambda b: _sums(b, depth, tokens, apart, few, True)), "leaf long, line long, masked string, around binary, docs long")
    if few is None:
        lines = lines.join(leaves, "leaf", "left_semi")
    summed = materialise(lines.groupBy("leaf", "line", "around").agg(F.max("masked").alias("masked"), F.sum("docs").alias("docs")), "lines")

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, now = None, Leaf(similar)
        for batch in batches:
            out = []
            for at, masked in zip(batch.column("leaf").to_pylist(), batch.column("masked").to_pylist()):
                if at != leaf:
                    leaf, now = at, Leaf(similar)
                out.append(now.template(masked))
            yield pa.RecordBatch.from_arrays([batch.column("leaf"), batch.column("line"), pa.array(out, pa.int64())], names=["leaf", "line", "template"])

    distinct = summed.where("around IS NULL").select("leaf", "line", "masked").repartition(n, "leaf").sortWithinPartitions("leaf", "masked")
    grown = materialise(distinct.mapInArrow(grow, "leaf long, line long, template long"), "templates")
    counted = materialise(summed.where("around IS NOT NULL").select("leaf", "line", "around", "docs").join(grown, ["leaf", "line"]).groupBy("leaf", "template", "around").agg(F.sum("docs").alias("docs")), "counted")
    held = counted.groupBy("leaf", "template").agg(F.count("*").alias("places"), F.sum("docs").alias("n_docs")).where(F.col("places") >= min_docs)
    named = grown.select("leaf", "line", "template")
    if not apart:
        return named.join(held, ["leaf", "template"]).select("line", "template", "n_docs").distinct()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Different surroundings of a template, min_docs at most; rows come sorted by leaf and template."""
        key, known = None, np.zeros((0, SLOTS), dtype=np.uint8)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(known), pa.int64()), pa.array([key[1]] * len(known), pa.int64()), pa.array([k.tobytes() for k in known], pa.binary())], names=["leaf", "template", "around"])

        for batch in batches:
            keys = np.stack([batch.column("leaf").to_numpy(), batch.column("template").to_numpy()], axis=1)
            rows = np.frombuffer(b"".join(batch.column("around").to_pylist()), dtype=np.uint8).reshape(-1, SLOTS)
            start = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1)))) if len(keys) else []
            for s, e in zip(start, [*start[1:], len(keys)]):
                if key != (at := tuple(keys[s].tolist())):
                    if key is not None:
                        yield out()
                    key, known = at, known[:0]
                if len(known) < min_docs:
                    known = different(rows[s:e], min_docs, known)
        if key is not None:
            yield out()

    # first by template and a min-hash, in which most copies agree, so that no task gets all documents of a common line
    schema, order = "leaf long, template long, around binary", ["leaf", "template", "around"]
    some = counted.join(held.select("leaf", "template"), ["leaf", "template"], "left_semi").select(*order)
    for by in (["leaf", "template", F.substring("around", 1, 1)], ["leaf", "template"]):
        some = some.repartition(n, *by).sortWithinPartitions(*order).mapInArrow(spread, schema)
    recurring = some.groupBy("leaf", "template").count().where(F.col("count") >= min_docs).join(held, ["leaf", "template"]).select("leaf", "template", "n_docs")
    return named.join(recurring, ["leaf", "template"]).select("line", "template", "n_docs").distinct()


def drop_recurring_lines(docs: DataFrame, min_docs: int = 10, similar: float = 0.7, depth: int = DEPTH, tokens: int = TOKENS, apart: bool = False) -> DataFrame:
    """The rows of docs (text and any other columns) without the lines of recurring templates.

    ``text`` keeps its other lines, joined by newlines; n_lines and n_removed are
    added. A template recurs if at least min_docs different texts hold it, with
    ``apart`` only those that hold it in different surroundings; lines agree if the
    share ``similar`` of their tokens is equal, so lines of three tokens or fewer only
    if all are. Blank lines, lines of variable fields only and lines with fewer tokens
    than ``tokens`` are never dropped.

    A null text stays null with no lines; an empty one has one empty line. Repeated
    rows count as one document. Columns n_lines and n_removed of docs are replaced.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.drop("n_lines", "n_removed")
    found = materialise(recurring_lines(docs, min_docs, similar, depth, tokens, apart).select("line").distinct(), "dropped")
    at = docs.columns.index("text")
    if found.count() <= SENT:
        dropped = np.sort(found.toArrow().column("line").to_numpy())
        return map_rows(docs, lambda b: _cut(b, at, dropped, depth, tokens), _COUNTS)
    # too many lines to send: each row gets the few of them that it holds, by a join on the lines
    row, gone = unused(docs, "row"), unused(docs, "dropped")
    keyed = docs.withColumn(row, F.xxhash64("text"))
    own = keyed.select(F.col(row).alias("row"), "text").mapInArrow(lambda b: _line_rows(b, depth, tokens), "row long, line long")
    lists = own.distinct().join(found, "line").groupBy(F.col("row").alias(row)).agg(F.collect_list("line").alias(gone))
    joined = keyed.join(lists, row, "left").select(*map(column, docs.columns), gone)
    return map_rows(joined, lambda b: _cut(b, at, None, depth, tokens), _COUNTS).drop(gone)


_COUNTS = StructType().add("n_lines", LongType()).add("n_removed", LongType())


def _line_rows(batches: Iterator[pa.RecordBatch], depth: int, tokens: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = list({(r, p[1]) for r, t in zip(batch.column("row").to_pylist(), batch.column("text")) for x in (t.as_py() or "").split("\n") if (p := parse(x, depth, tokens))})
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ([], []))], names=["row", "line"])


def _cut(batches: Iterator[pa.RecordBatch], at: int, dropped: np.ndarray | None, depth: int, tokens: int) -> Iterator[pa.RecordBatch]:
    """Drops lines; dropped holds their hashes, or else the last column does by row."""
    common = None if dropped is None else set(dropped.tolist())
    for batch in batches:
        texts, total, removed = [], [], []
        for i, t in enumerate(batch.column(at)):
            own = common if common is not None else set(batch.column(batch.num_columns - 1)[i].as_py() or ())
            every = t.as_py().split("\n") if t.is_valid else []
            kept = [x for x in every if not own or not (p := parse(x, depth, tokens)) or p[1] not in own]
            texts.append("\n".join(kept) if t.is_valid else None)
            total.append(len(every))
            removed.append(len(every) - len(kept))
        n = batch.num_columns
        columns = [pa.array(texts, batch.schema.field(i).type) if i == at else batch.column(i) for i in range(n)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], names=[f"_{i}" for i in range(n + 2)])
