"""Near-duplicate vectors by product quantisation.

Coarse inverted lists and the codebooks of residual subspaces are fitted on a
bounded sample (SAMPLE); every vector is indexed. A label has lists by its own size:
1, 2, 4 and so on, one for SHARE vectors at least. A vector is an entry of the
list of its nearest centroid h, and a query to those lists c whose cell comes so
near that they can hold a partner: d(x, c)**2 - d(x, h)**2 <= 2 * r * |c - h|,
where r is the distance that the threshold allows. The left side is linear in x
and at most 0 for every entry of c, so no partner is missed: probes are as many
as suffice. Of two lists, only the one with the smaller number queries the other.

In a list, table lookups give the distance of a query to each entry's code; what
is within r plus the entry's own coding error is compared exactly. So the codes
save work and lose nothing.

Equal vectors of a label are one entry with a key of its own and a count. A long
list is split into sub-lists of a bounded size, each met by all queries, which
stream past; of two sub-lists of a list, the entries of one are queries to the other.
Lists are as many as the sample can tell apart at most (a quarter of it), so beyond
some million different vectors of one label the work grows faster than they do.
Only link counts and the edges of a spanning forest leave a task, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import materialise, partitions, prepare
from .components import components

#: Vectors that centroids and codebooks are fitted on at most; those with the smallest hash.
SAMPLE = 8192
#: Entries that a task holds at most, and components of these together.
SUBLIST, HELD = 8192, 1 << 22
#: Subspaces, and codewords of each.
PARTS, WORDS = 8, 64
#: Vectors of a label that there is a list for. Short lists would cost more: in many dimensions a vector has to probe a share of the lists, however many there are.
SHARE = 512


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """At most k centroids of the rows, by Lloyd's rounds from rows drawn at random."""
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)


@dataclass
class Index:
    """Coarse centroids (lists, dim), and codebooks (parts, words, dim / parts) of the residuals."""

    centroids: np.ndarray
    books: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int) -> Index:
        centroids = k_means(sample, lists)
        rest = sample - centroids[nearest(sample, centroids)]
        parts = PARTS if sample.shape[1] % PARTS == 0 else 1
        return cls(centroids, np.stack([_pad(k_means(x, WORDS)) for x in np.split(rest, parts, axis=1)]))

    def encode(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals, and the distance of each from its code."""
        parts = np.split(rest, len(self.books), axis=1)
        codes = np.stack([nearest(x, b) for x, b in zip(parts, self.books)], axis=1).astype(np.uint8)
        coded = np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], axis=1)
        return codes, np.linalg.norm(rest - coded, axis=1)

    def distances(self, rest: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries' residuals to codes, summed from a table for each query and subspace."""
        out = np.zeros((len(rest), len(codes)))
        for m, (x, b) in enumerate(zip(np.split(rest, len(self.books), axis=1), self.books)):
            table = (x * x).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * x @ b.T
            out += table[:, codes[:, m]]
        return out


def _pad(book: np.ndarray) -> np.ndarray:
    return np.concatenate([book, np.repeat(book[-1:], WORDS - len(book), axis=0)])


def _floats(column: pa.Array, kind: str) -> list[np.ndarray | None]:
    """Vectors; None for those that link with nothing. Zeros have no sign."""
    out: list[np.ndarray | None] = []
    for v in column:
        x = None if not v.is_valid or v.values.null_count or not len(v.values) else np.asarray(v.values.to_numpy(zero_copy_only=False), dtype=kind) + np.dtype(kind).type(0)
        out.append(x if x is not None and np.isfinite(x).all() and np.any(x) else None)
    return out


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    """Rows of length 1 in double precision; scaled first, so that no square overflows or vanishes."""
    x = np.stack([np.frombuffer(b, dtype=kind) for b in raw]).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_ENTRY = "label long, scale int, list long, entry boolean, key long, node long, n long, raw binary"


def near_vectors(vectors: DataFrame, threshold: float = 0.98, sample: int = SAMPLE) -> DataFrame:
    """Links vectors (vec_id, embedding, label) of equal label with cosine >= threshold, in double precision.

    Returns for every row vec_id, n_links (other rows linked directly), component_id
    (the smallest vec_id reachable, itself included) and kept (whether that is its
    own). Null labels, and vectors that are null, empty, zero or have null or
    non-finite components, link with nothing; vectors of different lengths don't
    link. Rows that share a vec_id are rows of their own with one component; a null
    vec_id doesn't link. Other columns aren't read. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    prepare(spark)
    kind = "<f8" if isinstance(vectors.schema["embedding"].dataType.elementType, DoubleType) else "<f4"
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [None if x is None else x.tobytes() for x in _floats(batch.column("embedding"), kind)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").cast(pa.int64()), batch.column("label").cast(pa.int64()), pa.array(raw, pa.binary())], names=["vec_id", "label", "raw"])

    packed = materialise(vectors.select("vec_id", "embedding", "label").mapInArrow(pack, "vec_id long, label long, raw binary"), "vectors")
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("raw").isNotNull()
    grouped = packed.where(usable).groupBy("label", "raw").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"))
    entries = materialise(grouped.withColumn("key", F.monotonically_increasing_id()), "entries")
    sizes = entries.groupBy("label").agg(F.count("*").alias("size"))
    dims = entries.groupBy(F.octet_length("raw").alias("bytes")).count().orderBy(F.desc("count"), "bytes").first()
    indexes: list[Index] = []
    if dims is not None:
        few = entries.where(F.octet_length("raw") == dims["bytes"]).orderBy(F.xxhash64("raw"), "key").limit(sample).select("raw").toArrow()
        units, largest = _unit([x.as_py() for x in few.column("raw")], kind), sizes.agg(F.max("size")).first()[0]
        while 2 ** len(indexes) <= max(1, min(largest // SHARE, len(units) // 4)):
            indexes.append(Index.fit(units, 2 ** len(indexes)))
    scale = F.least(F.lit(len(indexes) - 1), F.expr(f"cast(floor(log2(greatest(1.0D, size / {SHARE})) + 1e-9D) AS int)"))
    size = np.dtype(kind).itemsize
    width = 0 if dims is None else dims["bytes"] // size
    n = partitions(vectors)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector as an entry of its list and as a query to those it has to probe; of odd lengths, as entries of a list for that length."""
        gaps = [np.sqrt(np.maximum((x.centroids**2).sum(1)[:, None] + (x.centroids**2).sum(1)[None, :] - 2 * x.centroids @ x.centroids.T, 0)) for x in indexes]
        for batch in batches:
            raw = batch.column("raw").to_pylist()
            label, key, node, count, scales = (batch.column(k).to_numpy() for k in ("label", "key", "node", "n", "scale"))
            dims = np.array([len(r) // size for r in raw])
            odd = np.flatnonzero(dims != width)
            row, to, entry = [odd], [-dims[odd]], [np.ones(len(odd), dtype=bool)]
            blocks = [(k, whole[at : at + 1024]) for k in range(len(indexes)) for whole in [np.flatnonzero((dims == width) & (scales == k))] for at in range(0, len(whole), 1024)]
            for k, some in blocks:
                c, gap = indexes[k].centroids, gaps[k]
                x = _unit([raw[i] for i in some], kind)
                d = (c * c).sum(axis=1)[None, :] - 2 * x @ c.T
                home = d.argmin(axis=1)
                reach = d - d[np.arange(len(x)), home][:, None] <= 2 * radius * gap[home] + 1e-9
                q, cell = np.nonzero(reach & (np.arange(len(c))[None, :] > home[:, None]))
                row += [some, some[q]]
                to += [home, cell]
                entry += [np.ones(len(some), dtype=bool), np.zeros(len(q), dtype=bool)]
            i, to, entry = np.concatenate(row), np.concatenate(to), np.concatenate(entry)
            for at in range(0, len(i), 20_000):
                j = i[at : at + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(label[j]), pa.array(scales[j]), pa.array(to[at : at + 20_000], pa.int64()), pa.array(entry[at : at + 20_000]), pa.array(key[j]), pa.array(node[j]), pa.array(count[j]), pa.array([raw[k] for k in j], pa.binary())], names=["label", "scale", "list", "entry", "key", "node", "n", "raw"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by list and sub-list, entries first: these are held, queries stream past."""
        place, held, links, a, b = None, None, {}, [], []

        def flush() -> pa.RecordBatch:
            ids = list(links)
            out = pa.RecordBatch.from_arrays(
                [pa.array(ids + a, pa.int64()), pa.array([links[i] for i in ids] + [None] * len(a), pa.int64()), pa.array([None] * len(ids) + b, pa.int64())],
                names=["u", "n", "v"],
            )
            links.clear(), a.clear(), b.clear()
            return out

        for batch in batches:
            label, scales, cell, sub, entry, key, node, count = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("label", "scale", "list", "sub", "entry", "key", "node", "n"))
            raw = batch.column("raw")
            cut = np.flatnonzero(np.concatenate(([True], (label[1:] != label[:-1]) | (cell[1:] != cell[:-1]) | (sub[1:] != sub[:-1]) | (entry[1:] != entry[:-1])))) if len(label) else np.zeros(0, int)
            for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(label)]):
                if (new := (label[s], cell[s], sub[s])) != place:
                    place, held = new, None
                if not entry[s] and held is None:
                    continue
                for at in range(s, e, 256):
                    to = min(e, at + 256)
                    some = _Entries(indexes[scales[s]], width, int(cell[s]), key[at:to], node[at:to], count[at:to], _unit(raw.slice(at, to - at).to_pylist(), kind))
                    if held is not None:
                        held.meet(some, radius, threshold, links, a, b)
                    if entry[s]:
                        some.meet(some, radius, threshold, links, a, b, itself=True)
                        held = some if held is None else held.add(some)
                if len(links) + len(a) > 200_000:
                    yield flush()
        yield flush()

    if not indexes:
        found = entries.select(F.col("key").alias("u"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("v"))
    else:
        sized = entries.join(sizes, "label").select("label", scale.alias("scale"), "key", "node", "n", "raw")
        placed = materialise(sized.mapInArrow(place, _ENTRY), "lists")
        most = max(1, min(SUBLIST, HELD // max(1, width)))
        subs = placed.where("entry").groupBy("label", "list").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("subs"))
        dealt = placed.join(subs, ["label", "list"]).withColumn("own", F.when(F.col("entry"), F.pmod(F.xxhash64("key"), F.col("subs")).cast("int")).otherwise(-1))
        spread = dealt.withColumn("sub", F.explode(F.expr("sequence(greatest(own, 0), subs - 1)"))).withColumn("entry", F.col("sub") == F.col("own")).drop("own", "subs")
        sorted_ = spread.repartition(n, "label", "list", "sub").sortWithinPartitions("label", "list", "sub", F.desc("entry"))
        found = materialise(sorted_.mapInArrow(compare, "u long, n long, v long"), "found")
    counts = found.where("n IS NOT NULL").groupBy(F.col("u").alias("key")).agg(F.sum("n").alias("partners"))
    roots = components(found.where("v IS NOT NULL").select("u", "v"))
    classes = entries.withColumnRenamed("n", "copies").join(counts, "key", "left").join(roots, "node", "left")
    known = packed.where(usable).join(classes, ["label", "raw"]).select("vec_id", (F.coalesce("partners", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    others = packed.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionByName(others).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


class _Entries:
    """Vectors of one list: keys, ids, counts, unit vectors, and codes with their errors."""

    def __init__(self, index: Index, width: int, cell: int, key: np.ndarray, node: np.ndarray, count: np.ndarray, unit: np.ndarray) -> None:
        self.index, self.key, self.node, self.count, self.unit = index, key, node, count, unit
        self.coded = cell >= 0 and unit.shape[1] == width
        self.label = np.arange(len(node))
        if self.coded:
            self.rest = unit - index.centroids[cell]
            self.codes, self.error = index.encode(self.rest)

    def add(self, other: _Entries) -> _Entries:
        self.label = np.concatenate([self.label, other.label + len(self.node)])
        for k in ("key", "node", "count", "unit", *(("rest", "codes", "error") if self.coded else ())):
            setattr(self, k, np.concatenate([getattr(self, k), getattr(other, k)]))
        return self

    def meet(self, queries: _Entries, radius: float, threshold: float, links: dict[int, int], a: list[int], b: list[int], itself: bool = False) -> None:
        """Adds the links of queries with these entries, and edges that connect what they connect."""
        if self.coded:
            near = self.index.distances(queries.rest, self.codes) <= (radius + self.error[None, :]) ** 2 + 1e-9
            q, e = np.nonzero(near)
        else:
            q, e = (x.ravel() for x in np.indices((len(queries.node), len(self.node))))
        if itself:
            q, e = q[e > q], e[e > q]
        for at in range(0, len(q), 1 << 16):
            i, j = q[at : at + (1 << 16)], e[at : at + (1 << 16)]
            hit = np.einsum("ij,ij->i", queries.unit[i], self.unit[j]) >= threshold
            i, j = i[hit], j[hit]
            for ids, n in ((queries.key[i], self.count[j]), (self.key[j], queries.count[i])):
                names, which = np.unique(ids, return_inverse=True)
                for name, total in zip(names.tolist(), np.bincount(which, weights=n).astype(np.int64).tolist()):
                    links[name] = links.get(name, 0) + total
            starts = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))) if len(i) else []
            for s, t in zip(starts, [*starts[1:], len(i)]):
                met = j[s:t]
                a.append(int(queries.node[i[s]]))
                b.append(int(self.node[met[0]]))
                groups, first = np.unique(self.label[met], return_index=True)
                if len(groups) > 1:  # what the query connects is one from now on
                    a.extend(self.node[met[first[1:]]].tolist())
                    b.extend([int(self.node[met[first[0]]])] * (len(groups) - 1))
                    self.label[np.isin(self.label, groups)] = groups[0]
