"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Every text becomes a fixed vector of transformed statistics (lengths, character classes, repetition, line shape). Each
class gets a mean and a covariance shrunk towards a scaled identity (the oracle-approximating rule, which needs nothing
but the covariance itself and the number of rows); its Cholesky factor and log-determinant are computed once and cached in the
model. A score is the logistic of the difference of the two log densities plus the log prior odds.

Defined cases. A null text, or one without words, scores 0 (and teaches nothing) where there is a model. Labels that
are null are ignored; repeated labels of an id are averaged (1 from a half upwards); labels of unknown ids, and repeated
document rows, do no harm (a repeated training row counts twice). If a class has fewer than two training rows, every score is the
share of class 1 among the training rows, or 0.5 without any. Extra columns are ignored. Ids, languages and sources are never inputs.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, label_of, slices

NAMES = (
    "log_words", "log_word_bytes", "upper", "digit", "space", "punct", "symbol", "beyond_ascii", "symbol_ends_word",
    "shouted", "distinct_words", "top_word", "distinct_pairs", "distinct_lines", "log_line_words", "longest_word", "bars", "short_words",
)
D = len(NAMES)
#: Labels that are sent to the documents, at most; beyond it documents are joined to them by a shuffle.
IDS = 1_000_000
#: Character classes by byte: 0 lower-case letters, 1 upper-case letters, 2 digits, 3 white space, 4 punctuation of prose, 5 other symbols, 6 and 7 bytes beyond ASCII.
_CLASS = np.full(256, 5, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[list(b" \t\n\r\x0b\x0c")] = 3
_CLASS[list(b".,;:'\"?()-")] = 4
_CLASS[128:192] = 7
_CLASS[192:] = 6


def statistics(text: str | None) -> np.ndarray:
    """The statistics of a text; zeros without words."""
    raw = (text or "").encode()
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return np.zeros(D)
    cls = _CLASS[np.frombuffer(raw, np.uint8)]
    share = np.bincount(cls, minlength=8) / size
    symbol = cls == 5
    count = Counter(words)
    lines = raw.split(b"\n")
    lengths = np.fromiter(map(len, words), np.int64, n)
    shouted = int((((cls[:-1] == 1) & (cls[1:] == 1)).sum()))
    part = np.array([share[1], share[2], share[3], share[4], share[5], share[6], int((symbol[:-1] & (cls[1:] == 3)).sum() + symbol[-1]) / n, shouted / size])
    return np.concatenate([
        [np.log1p(n), np.log(lengths.mean())],
        np.log(part + 0.03),
        [
            np.log((len(count) + 5) / (n + 5)),
            np.log((max(count.values()) + 1) / (n + 20)),
            np.log((len(set(zip(words, words[1:]))) + 6) / (n + 5)),
            np.log((len(set(lines)) + 2) / (len(lines) + 2)),
            np.log1p(n / len(lines)),
            np.log(lengths.max()),
            np.log(count.get(b"|", 0) / n + 0.03),
            np.log(((lengths <= 3).sum() + 1) / (n + 5)),
        ],
    ])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x array<double>)."""

    def run(batches):
        for b in slices(batches):
            x = [statistics(t) for t in b.column(1).to_pylist()]
            flat = np.concatenate(x) if x else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * D, pa.int32()), pa.array(flat))], names=["doc_id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Model:
    """``lower[c]``: Cholesky factor of class c's shrunk covariance, in standardised units; ``fixed``: the score where no fit is possible."""

    centre: np.ndarray
    scale: np.ndarray
    mean: np.ndarray
    lower: np.ndarray
    log_det: np.ndarray
    log_prior: np.ndarray
    fixed: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.fixed is not None:
            return np.full(len(x), self.fixed)
        empty = ~x.any(1)
        z = (x - self.centre) / self.scale
        log_density = [self.log_prior[c] - 0.5 * self.log_det[c] - 0.5 * (np.linalg.solve(self.lower[c], (z - self.mean[c]).T) ** 2).sum(0) for c in (0, 1)]
        return np.where(empty, 0.0, 1 / (1 + np.exp(np.clip(log_density[0] - log_density[1], -500, 500))))


def shrunk(s: np.ndarray, n: float) -> np.ndarray:
    """Oracle-approximating shrinkage of a covariance from n rows towards a scaled identity."""
    p = len(s)
    trace, square = np.trace(s), (s * s).sum()
    bottom = (n + 1 - 2 / p) * (square - trace * trace / p)
    rho = 1.0 if bottom <= 0 else min(1.0, ((1 - 2 / p) * square + trace * trace) / bottom)
    return (1 - rho) * s + (rho * trace / p + 1e-6) * np.eye(p)


def fit(rows: DataFrame) -> Model:
    """``rows`` has (y, x). One pass of class sums and products, combined in each partition before they are added up."""

    def sums(batches):
        total = np.zeros((2, 1 + D + D * D))
        for b in batches:
            y = b.column(0).to_numpy()
            x = b.column(1).flatten().to_numpy().reshape(-1, D)
            for c in (0, 1):
                own = x[(y == c) & x.any(1)]
                total[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        for c in (0, 1):
            if total[c, 0]:
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([total[c].tolist()])], names=["y", "m"])

    parts = rows.select("y", "x").mapInArrow(sums, "y int, m array<double>")
    rows = parts.select("y", F.posexplode("m").alias("i", "v")).groupBy("y", "i").agg(F.sum("v").alias("v")).collect()
    m = np.zeros((2, 1 + D + D * D))
    for r in rows:
        m[r["y"], r["i"]] = r["v"]
    n = m[:, 0]
    blank = np.zeros(D)
    if n.min() < 2:
        return Model(blank, blank + 1, m, m, n, n, float(n[1] / n.sum()) if n.sum() else 0.5)
    mean = m[:, 1 : 1 + D] / n[:, None]
    cov = m[:, 1 + D :].reshape(2, D, D) / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    centre = mean.mean(0)
    scale = np.sqrt(np.maximum(np.einsum("cii->ci", cov).mean(0), 1e-8))
    cov = np.stack([shrunk(cov[c] / np.outer(scale, scale), n[c]) for c in (0, 1)])
    lower = np.linalg.cholesky(cov)
    log_det = 2 * np.log(np.einsum("cii->ci", lower)).sum(1)
    return Model(centre, scale, (mean - centre) / scale, lower, log_det, np.log(n / n.sum()))


def learnt(docs: DataFrame, labels: DataFrame, modulus: int = 3, rest: int = 1) -> Model:
    """The model of the labelled documents; ids whose crc32 leaves ``rest`` teach nothing."""
    known = label_of(labels, "quality").where(~held_out("doc_id", modulus, rest))
    few = known.limit(IDS + 1).count() <= IDS
    train = docs.select("doc_id", "text").join(F.broadcast(known) if few else known, "doc_id")
    y = train.select(F.col("y").cast("long").alias("doc_id"), "text")
    return fit(document_statistics(y).select(F.col("doc_id").cast("int").alias("y"), "x"))


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted) of every row."""

    def run(batches):
        for b in slices(batches):
            s = model.scores(np.array([statistics(t) for t in b.column(1).to_pylist()]).reshape(-1, D))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 3, rest: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    scored = score(docs, learnt(docs, labels, modulus, rest))
    return scored.select("doc_id", held_out("doc_id", modulus, rest).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, unchanged; fitted as ``classify`` is."""
    model = learnt(docs, labels)
    at = docs.columns.index("text")

    def run(batches):
        for b in slices(batches):
            s = model.scores(np.array([statistics(t) for t in b.column(at).to_pylist()]).reshape(-1, D))
            yield b.filter(pa.array(s >= 0.5))

    return docs.mapInArrow(run, docs.schema)
