"""Toxicity of texts: disguised words are restored, then judged by a lexicon learned from labels.

1. A character language model is counted over all documents; the counts of a
   batch are summed before they are shuffled, and there are SYMBOLS ** 3 at most.
2. Every text is restored by noisy-channel decoding (see deobfuscate).
3. From a bounded sample of labelled rows (MAX_TRAIN) come the words and word
   beginnings that stand out in toxic texts. Near copies of a text already
   counted don't count again, else the rare words of a copied text would.
4. A text's evidence is the sum of its strongest restored words; a logistic curve
   makes it a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grams, mix, prepare, word_hashes
from .deobfuscate import SYMBOLS, Restorer, Wanted, language_model, trigram_counts
from .quality import logistic_curve, sample, train_fold

#: Labelled rows that the lexicon is learned from at most; those with the smallest hash of their doc_id.
MAX_TRAIN = 8000
#: Words that add up to a text's evidence.
STRONGEST = 3
#: Letters of the word beginnings.
BEGINNINGS = (4, 5, 6)


def corpus_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, dtype=np.int64)
        for batch in batches:
            for t in batch.column("text"):
                total += trigram_counts(t.as_py())
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["trigram", "n"])

    counts = np.zeros(SYMBOLS**3, dtype=np.float64)
    for row in docs.select("text").mapInArrow(run, "trigram int, n long").groupBy("trigram").agg(F.sum(F.col("n").cast("double")).alias("n")).collect():
        counts[row.trigram] = row.n
    return counts


def signs(word: str) -> list[str]:
    """A word, and its beginnings where it goes on."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


def copy_keys(text: str | None) -> list[int]:
    """Three min-hashes of the five-word shingles of a text (of its words, if it has fewer)."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    found = grams(words, min(5, max(1, len(words))))
    return [int(mix(found ^ np.uint64(k)).min()) >> 1 if len(found) else 0 for k in (1, 2, 3)]


def copies(keys: list[list[int]]) -> np.ndarray:
    """Which rows share two of their three min-hashes with earlier rows."""
    seen: list[set[int]] = [set(), set(), set()]
    out = np.zeros(len(keys), dtype=bool)
    for i, row in enumerate(keys):
        out[i] = sum(k in s for k, s in zip(row, seen)) >= 2
        for k, s in zip(row, seen):
            s.add(k)
    return out


def lexicon(rows: list[np.ndarray], keys: list[list[int]], y: np.ndarray, size: int) -> np.ndarray:
    """Weights by number of sign; 0 for what doesn't stand out in toxic rows (the distinct signs' numbers of each).

    A sign needs three toxic rows and a binomial log-likelihood ratio against the
    share of toxic rows beyond what the best of so many signs would reach by chance.
    Its weight is its log-odds ratio with three clean rows added.
    """
    fresh = ~copies(keys)
    weights = np.zeros(size)
    toxic, clean = np.flatnonzero((y > 0) & fresh), np.flatnonzero((y <= 0) & fresh)
    if not len(toxic) or not len(clean):
        return weights
    t, c = (np.bincount(np.concatenate([rows[i] for i in pick]), minlength=size) for pick in (toxic, clean))
    tried = np.flatnonzero(t >= 3)
    base, needed = len(toxic) / (len(toxic) + len(clean)), np.log(max(1, len(tried))) + 2
    n, m = t[tried], c[tried]
    share = n / (n + m)
    ratio = n * np.log(share / base) + m * np.log(np.maximum(1 - share, 1e-300) / (1 - base))
    weight = np.log(n / len(toxic)) - np.log((m + 3) / (len(clean) + 3))
    keep = (share > base) & (ratio >= needed) & (weight > 0)
    weights[tried[keep]] = weight[keep]
    return weights


def evidence(words: Iterable[str], weights: dict[str, float]) -> float:
    """The sum of the weights of the strongest words; a word's is that of its strongest sign."""
    found = [w for w in (max((weights.get(s, 0.0) for s in signs(x)), default=0.0) for x in words) if w]
    return sum(sorted(found, reverse=True)[:STRONGEST])


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 4, held: int = 2, threshold: float = 0.3, most: int = MAX_TRAIN) -> DataFrame:
    """Scores every whole text of docs (doc_id, text); labels has doc_id and the label.

    Learns labels only from rows whose crc32(doc_id as text) modulo the modulus
    isn't ``held``. Returns doc_id, held_out, score (0 to 1, higher: label 1
    likelier) and predicted (1 from the threshold on) for every row.

    Null and empty texts score as texts without evidence. Repeated rows and ties
    are scored alike; a null doc_id isn't held out. Other columns aren't read.
    Without labels of both classes every score is near the share of the one there
    is (0.5 without labels). An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    learn, out = train_fold(modulus, held)
    model = language_model(corpus_counts(docs))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for batch in batches:
            words = [" ".join(sorted(restorer.restore(t.as_py()))) for t in batch.column("text")]
            keys = [copy_keys(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.string()), pa.array(keys, pa.list_(pa.int64())), batch.column("y")], names=["doc_id", "words", "keys", "y"])

    learned = sample(docs, labels, label, learn, most).select("doc_id", "text", "y").mapInArrow(extract, "doc_id long, words string, keys array<long>, y int").toArrow().sort_by("doc_id")
    rows, y = [x.as_py().split() for x in learned.column("words")], learned.column("y").to_numpy()
    weights, slope, offset = fit(rows, learned.column("keys").to_pylist(), y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Wanted((w for w in weights if not w.endswith("*")), (w[:-1] for w in weights if w.endswith("*")))
        restorer = Restorer(model, wanted=wanted, keep=lambda w: any(s in weights for s in signs(w)))
        strongest: dict[str, float] = {}
        for batch in batches:
            scores = []
            for t in batch.column("text"):
                if len(strongest) > restorer.remember:
                    strongest.clear()
                found = []
                for w in restorer.restore(t.as_py()):
                    x = strongest.get(w)
                    if x is None:
                        x = strongest[w] = max(weights.get(s, 0.0) for s in signs(w))
                    if x:
                        found.append(x)
                scores.append(sum(sorted(found, reverse=True)[:STRONGEST]))
            score = 1 / (1 + np.exp(-np.clip(slope * np.array(scores, dtype=np.float64) + offset, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", out.alias("held_out"), "score", "predicted")


def fit(rows: list[list[str]], keys: list[list[int]], y: np.ndarray) -> tuple[dict[str, float], float, float]:
    """The lexicon of all rows, and slope and offset of the logistic curve of the evidence, which for each fifth of the rows is by the lexicon of the others."""
    y = np.asarray(y, dtype=np.int64)
    if len(np.unique(y)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return {}, 0.0, float(np.log(share / (1 - share)))
    frequent = Counter(w for words, label in zip(rows, y) if label > 0 for w in words)
    top: dict[str, str] = {}  # a beginning has to stand out without its most frequent word, which speaks for itself
    for w, _ in sorted(frequent.items(), key=lambda x: (-x[1], x[0])):
        for s in signs(w)[1:]:
            top.setdefault(s, w)
    number: dict[str, int] = {}
    of = [np.array(list({number.setdefault(s, len(number)) for w in words for s in signs(w) if top.get(s) != w}), dtype=np.int32) for words in rows]
    names = list(number)

    def learn(pick: np.ndarray) -> dict[str, float]:
        found = lexicon([of[i] for i in pick], [keys[i] for i in pick], y[pick], len(names))
        return {names[i]: float(found[i]) for i in np.flatnonzero(found)}

    fold, found = np.arange(len(y)) % 5, np.zeros(len(y))
    for k in range(5):
        weights = learn(np.flatnonzero(fold != k))
        found[fold == k] = [evidence(rows[i], weights) for i in np.flatnonzero(fold == k)]
    slope, offset = logistic_curve(found, y)
    return learn(np.arange(len(y))), max(slope, 0.0), offset
