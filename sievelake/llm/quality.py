"""A quality classifier: naive Bayes support vectors.

Features are hashed n-gram indicators of three views of a text: its words, the
runs of its character classes, and which words repeat the one before. Each
indicator is scaled by its class log-count ratio; a linear model with hinge loss
is fitted to the scaled indicators by dual coordinate descent. Its margin becomes
a score from 0 to 1 by a logistic curve.

The model is fitted on the driver, on a bounded sample of the labelled rows
(MAX_TRAIN); every text is read whole, in training and in scoring.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import grams, map_rows, mix, prepare, word_hashes

#: Labelled rows that the model is fitted on at most; those with the smallest hash of their doc_id.
MAX_TRAIN = 6000
#: Hashed features.
BITS = 18
#: Bytes of a text that are looked at a time.
_SEGMENT = 1 << 20


def _classes() -> np.ndarray:
    """A class for each byte: small and capital letters (bytes beyond ASCII count as small), digits, and each other sign."""
    of = np.arange(256, dtype=np.uint8)
    of[ord("a") : ord("z") + 1] = of[128:] = ord("a")
    of[ord("A") : ord("Z") + 1] = ord("A")
    of[ord("0") : ord("9") + 1] = ord("0")
    return of


_CLASS = _classes()


def _runs(x: np.ndarray) -> np.ndarray:
    """x without what equals its left neighbour."""
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """The distinct hashed n-gram indicators of a whole text; none for a null or empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return np.zeros(0, dtype=np.uint32)
    words = word_hashes(raw)
    found = [words, grams(words, 2) + np.uint64(1)] if len(words) else []
    again = np.append(np.zeros(min(1, len(words)), dtype=np.uint64), (words[1:] == words[:-1]).astype(np.uint64))
    shape = np.concatenate([_runs(_CLASS[np.frombuffer(raw, dtype=np.uint8, count=min(_SEGMENT, len(raw) - at), offset=at)]) for at in range(0, len(raw), _SEGMENT)]).astype(np.uint64)
    for n in (1, 2, 3, 4, 6):
        found.append(grams(shape + np.uint64(7), n) + np.uint64(n << 8))
    for n in (3, 5):
        found.append(np.unique(grams(again + np.uint64(3), n)) + np.uint64(n << 16))
    folded = (mix(np.concatenate(found)) >> np.uint64(64 - bits)).astype(np.uint32)
    mark = np.zeros(1 << bits, dtype=bool)
    mark[folded] = True
    return np.flatnonzero(mark).astype(np.uint32)


def pack(found: np.ndarray, bits: int = BITS) -> bytes:
    """Indicators as numbers, or as a bitmap if that is shorter: never more than a byte and 2**bits bits."""
    if 32 * len(found) < 1 << bits:
        return b"n" + found.astype("<u4").tobytes()
    mark = np.zeros(1 << bits, dtype=bool)
    mark[found] = True
    return b"b" + np.packbits(mark).tobytes()


class Packed(Sequence):
    """Rows of indicators, kept packed, so that a sample of long texts is bounded in bytes: unpacked when one is looked at."""

    def __init__(self, rows: list[bytes]) -> None:
        self.rows = rows

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> np.ndarray:
        raw = self.rows[i]
        if raw[:1] == b"n":
            return np.frombuffer(raw, dtype="<u4", offset=1)
        return np.flatnonzero(np.unpackbits(np.frombuffer(raw, dtype=np.uint8, offset=1))).astype(np.uint32)

    def some(self, pick: np.ndarray) -> Packed:
        return Packed([self.rows[i] for i in pick])


@dataclass
class Model:
    """weights of the indicators, bias of the margin, and the logistic curve of the margin."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum()) / max(1.0, len(found)) ** 0.5 + self.bias

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.offset, -40, 40))))


def log_count_ratios(rows: Sequence[np.ndarray], y: np.ndarray, bits: int, smooth: float = 1.0) -> np.ndarray:
    """log((p / |p|) / (q / |q|)) of the smoothed indicator counts p of class 1 and q of class 0."""
    p, q = np.full(1 << bits, smooth), np.full(1 << bits, smooth)
    for x, label in zip(rows, y):
        (p if label else q)[x] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows: Sequence[np.ndarray], y: np.ndarray, scale: np.ndarray, c: float = 1.0, epochs: int = 12, seed: int = 7, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Minimises |w|**2 / 2 + C * sum(hinge), one dual variable at a time; rows are unit vectors of scaled indicators.

    The bias is the weight of a constant feature. C is shared out so that both
    classes weigh the same.
    """
    sign = np.where(y > 0, 1.0, -1.0)
    share = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y <= 0).sum())))
    w, b, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    norm = np.zeros(len(rows))
    q = np.ones(len(rows))
    for i, x in enumerate(rows):
        norm[i] = max(1.0, len(x)) ** -0.5
        q[i] += (scale[x] ** 2).sum() * norm[i] ** 2
    order, rng = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        moved = 0.0
        for i in order.tolist():
            x = rows[i]
            value = scale[x] * norm[i]
            g = sign[i] * (w[x] @ value + b) - 1
            new = min(max(alpha[i] - g / q[i], 0.0), c * share[i])
            if step := new - alpha[i]:
                alpha[i] = new
                w[x] += step * sign[i] * value
                b += step * sign[i]
                moved = max(moved, abs(step))
        if moved < tolerance:
            break
    return w, b


def logistic_curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve of the margins, by Newton's method on smoothed targets (Platt)."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        g = np.array([((p - target) * margin).sum() + 1e-3 * a, (p - target).sum()])
        h = p * (1 - p) + 1e-9
        m = np.array([[(h * margin * margin).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(m, g)
        a, b = a - float(np.clip(step[0], -5, 5)), b - float(np.clip(step[1], -5, 5))
        if abs(step).max() < 1e-6:
            break
    return a, b


def fit(rows: Packed, y: np.ndarray, bits: int = BITS) -> Model:
    """Fits ratios, weights and curve; the curve's margins come from two folds, so they aren't those of rows just learned.

    With one class only, or no rows, every score is that class's share (a half without rows).
    """
    y = np.asarray(y, dtype=np.int64)
    if len(np.unique(y)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(1 << bits, dtype=np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))

    def part(pick: np.ndarray) -> Model:
        some = rows.some(pick)
        ratio = log_count_ratios(some, y[pick], bits)
        w, b = dual_coordinate_descent(some, y[pick], ratio)
        return Model((w * ratio).astype(np.float32), b, 1.0, 0.0)

    def margins(model: Model, pick: np.ndarray) -> np.ndarray:
        return np.array([model.margin(rows[i]) for i in pick])

    fold = np.arange(len(y)) % 2
    held = np.zeros(len(y))
    for k in (0, 1):
        if len(np.unique(y[fold != k])) == 2:
            held[fold == k] = margins(part(np.flatnonzero(fold != k)), np.flatnonzero(fold == k))
    model = part(np.arange(len(y)))
    slope, offset = logistic_curve(held, y)
    return Model(model.weights, model.bias, max(slope, 0.0), offset)


def sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, most: int = MAX_TRAIN) -> DataFrame:
    """doc_id, text and y of at most so many labelled documents, by the hash of their doc_id.

    The sampled labels are few, so they are what is sent to the documents. Null
    labels don't count; a doc_id with several labels has their largest, one with
    several texts the first by order.
    """
    spark = docs.sparkSession
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & train)
        .groupBy("doc_id")
        .agg((F.max(label) > 0).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    bounded = spark.createDataFrame(chosen.collect(), "doc_id long, y int")
    return docs.select("doc_id", "text").join(F.broadcast(bounded), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def train_fold(modulus: int, held: int) -> tuple[Column, Column]:
    """Columns of doc_id: whether a row may be learned from, and whether it is held out."""
    out = F.crc32(F.col("doc_id").cast("string")) % modulus == held
    return ~out, F.coalesce(out, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int = MAX_TRAIN) -> Model:
    """The model of a bounded sample of the rows that may be learned from."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pack(features(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column("doc_id"), batch.column("y")], names=["found", "doc_id", "y"])

    rows = sample(docs, labels, label, learn, most).select("doc_id", "text", "y").mapInArrow(extract, "found binary, doc_id long, y int").toArrow()
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    return fit(Packed([rows.column("found")[int(i)].as_py() for i in order]), rows.column("y").to_numpy()[order])


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, held: int = 0, threshold: float = 0.3, most: int = MAX_TRAIN) -> DataFrame:
    """Scores every whole text of docs (doc_id, text); labels has doc_id and the label.

    Learns only from rows whose crc32(doc_id as text) modulo the modulus isn't
    ``held``, and never sees other columns. Returns doc_id, held_out, score (0 to 1,
    higher: label 1 likelier) and predicted (1 from the threshold on) for every row.

    Null and empty texts score as texts without features. Repeated rows and ties
    are scored alike; a null doc_id isn't held out. Without labels every score is
    0.5, with one class only near that class. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    learn, out = train_fold(modulus, held)
    model = train(docs, labels, label, learn, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.array([model.score(features(t.as_py())) for t in batch.column("text")], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", out.alias("held_out"), "score", "predicted")


def keep_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, held: int = 0, threshold: float = 0.3, most: int = MAX_TRAIN) -> DataFrame:
    """The rows of docs, with all their columns, that quality_scores predicts 1 for."""
    prepare(docs.sparkSession)
    model = train(docs, labels, label, train_fold(modulus, held)[0], most)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.score(features(t.as_py())) >= threshold for t in batch.column(at)], pa.bool_()))

    return map_rows(docs, run)
