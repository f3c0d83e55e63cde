"""Toxic passages as maximum-scoring segments of token log-odds.

Tokens (words and, for words not seen, their first letters) get the log-odds of their rates in toxic and other documents
under an informative Dirichlet prior, and keep them if they are significant; any other token costs a little. A linear scan finds
every maximal segment of a text, and extreme-value theory for segment sums turns a segment's sum and the text's length into how
many such segments chance would give. A logistic curve over that number, fitted on the training rows, gives the score.

Defined cases. A null or empty text has no segment and scores the same as any text without a toxic token. Null labels are
ignored, repeated ones averaged. Without toxic or without other training rows every score is the share of toxic ones (0 without
any). Rows that share an id teach once, by their smallest text. Repeated rows and null ids are scored as they come; extra columns are ignored. Texts are scanned whole.

Bounds. The model learns from at most ``SAMPLE`` labelled documents, taken by the order of a hash of the id, and keeps at most ``KEEP`` tokens.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, label_of

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 20_000
#: Tokens of the model, at most.
KEEP = 50_000
#: Lengths in bytes of the beginnings that stand in for a word that was not seen, longest first.
STEMS = (6, 5, 4)
#: What a token without significant log-odds costs.
COST = 0.5

_TABLE = bytes(b if chr(b).isalpha() or b >= 128 else 32 for b in range(256))
#: Whether bytes may hold other characters beyond ASCII than Latin letters (U+00C0 to U+02BF).
_BEYOND = re.compile(rb"[\xc2\xcb-\xff]|\xc3[\x97\xb7]").search


class _Letters(dict):
    """Characters beyond ASCII that are no letters or marks become spaces."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        self[code] = out = code if code < 128 or c.isalpha() or unicodedata.category(c)[0] == "M" else 32
        return out


_letters = _Letters()


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters and marks."""
    text = (text or "").lower()
    raw = text.encode()
    if _BEYOND(raw):
        raw = text.translate(_letters).encode()
    return raw.translate(_TABLE).split()


def segments(scores) -> list[tuple[int, int, float]]:
    """Every maximal scoring segment (start, end, sum) of a sequence, in one pass."""
    # start, end, sum before it, sum up to its end, the nearest earlier one with a smaller sum before it
    found: list[list] = []
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        now = [i, i + 1, before, total, -1]
        while found:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= now[2]:
                j = found[j][4]
            now[4] = j
            if j < 0 or found[j][3] >= now[3]:
                break
            now = [found[j][0], now[1], found[j][2], now[3], found[j][4]]
            del found[j:]
        found.append(now)
    return [(a, b, up - low) for a, b, low, up, _ in found]


@dataclass
class Model:
    odds: dict[bytes, float]
    rate: float = 1.0  # lambda of the extreme-value law
    constant: float = 0.1  # its K
    curve: tuple[float, float] = (0.0, 1.0)
    fixed: float | None = None
    memo: dict[bytes, float] = field(default_factory=dict)

    def token(self, w: bytes) -> float:
        s = self.memo.get(w)
        if s is None:
            s = self.odds.get(w)
            for k in STEMS if s is None else ():
                if len(w) > k and (s := self.odds.get(b"^" + w[:k])) is not None:
                    break
            s = -COST if s is None else s
            if len(self.memo) > 400_000:
                self.memo.clear()
            self.memo[w] = s
        return s

    def passages(self, text: str | None, chance: float = 0.05) -> list[tuple[int, int, float, float]]:
        """(first token, end token, sum, expected number by chance) of the segments that chance gives fewer than ``chance`` times."""
        words = tokens(text)
        memo = self.memo
        try:
            s = [memo[w] for w in words]
        except KeyError:
            s = [self.token(w) for w in words]
        if not s or max(s) <= 0:
            return []
        size = self.constant * len(s)
        return [(a, b, x, e) for a, b, x in segments(s) if (e := size * np.exp(-self.rate * x)) < chance]

    def evidence(self, text: str | None) -> float:
        """Sum over the significant passages of how far below one the expected number is, in nats, its square root."""
        return float(np.sqrt(sum(-np.log(max(e, 1e-300)) for *_, e in self.passages(text))))

    def score(self, text: str | None) -> float:
        if self.fixed is not None:
            return self.fixed
        return float(1 / (1 + np.exp(np.clip(-(self.curve[0] + self.curve[1] * self.evidence(text)), -500, 500))))

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}


def _counts(docs: DataFrame) -> DataFrame:
    """(y, text) -> (token, toxic, other): in how many texts of each class it stands, added up in each batch first."""

    def run(batches):
        from collections import Counter

        for b in batches:
            seen = (Counter(), Counter())
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = tokens(text)
                kinds = set(words)
                seen[y].update(kinds)
                seen[y].update({b"^" + w[:k] for w in kinds for k in STEMS if len(w) > k})
            keys = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())], names=["token", "toxic", "other"])

    return docs.select("y", "text").mapInArrow(run, "token binary, toxic long, other long").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _rate(probabilities: np.ndarray, scores: np.ndarray) -> float:
    """The positive root of E[exp(rate * score)] = 1."""
    low, high = 1e-6, 50.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (low, mid) if (probabilities * np.exp(np.clip(mid * scores, -700, 700))).sum() > 1 else (mid, high)
    return low


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep: int = KEEP, prior: float = 0.1, least_z: float = 3.0) -> Model:
    """``docs`` has (doc_id, text), ``labels`` (doc_id, y)."""
    present = docs.select("doc_id").join(labels, "doc_id", "left_semi").distinct()
    chosen = labels.join(present, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    train = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("y", "text").persist()
    try:
        sizes = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
        toxic, other = sizes.get(1, 0), sizes.get(0, 0)
        if not toxic or not other:
            return Model({}, fixed=1.0 if toxic else 0.0)
        counts = _counts(train).persist()
        is_word = ~F.col("token").startswith(F.lit(b"^"))
        n = counts.where(is_word).agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).first()
        n1, n0 = int(n["toxic"] or 0), int(n["other"] or 0)
        if not n1 or not n0:
            counts.unpersist()
            return Model({}, fixed=toxic / (toxic + other))
        # A token's prior is in proportion to its count over both classes; all of it weighs ``prior`` times what was counted.
        prior *= n1 + n0
        a = F.lit(prior) * (F.col("toxic") + F.col("other")) / (n1 + n0)
        y1, y0 = F.col("toxic") + a, F.col("other") + a
        odds = F.log(y1 / (n1 + prior - y1)) - F.log(y0 / (n0 + prior - y0))
        z = odds / F.sqrt(1 / y1 + 1 / y0)
        top = counts.select("token", odds.alias("odds"), z.alias("z"), "other").where((F.col("z") >= least_z) & (F.col("odds") > COST)).orderBy(F.desc("z"), "token").limit(keep).collect()
        counts.unpersist()
        model = Model({bytes(r["token"]): float(r["odds"]) for r in top})
        # Background rates: of listed words in other documents, smoothed; the rest costs COST.
        own = [(float(r["odds"]), (r["other"] + 0.5) / (n0 + 1.0)) for r in top if not bytes(r["token"]).startswith(b"^")]
        if own:
            s, p = np.array([x for x, _ in own] + [-COST]), np.array([x for _, x in own])
            p = np.append(p * min(1.0, 0.5 / p.sum()), 0)
            p[-1] = 1 - p[:-1].sum()
            if (s * p).sum() < 0:
                model.rate = _rate(p, s)
        # The curve: at most ``sample`` pairs of evidence and label come to the driver.
        pairs = train.select("y", F.pandas_udf(lambda t: t.map(model.evidence), "double")("text").alias("e")).collect()
        model.curve = _logistic(np.array([r["e"] for r in pairs]), np.array([r["y"] for r in pairs], float))
        return model
    finally:
        train.unpersist()


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    w = np.zeros(2)
    a = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), a.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted, n_passages) of every row."""

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            s = np.array([model.score(t) for t in texts], float)
            found = pa.array([len(model.passages(t)) if x >= threshold else 0 for t, x in zip(texts, s)], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32)), found], names=["doc_id", "score", "predicted", "n_passages"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int, n_passages int")


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 4, rest: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_passages) of every row; ids whose crc32 leaves ``rest`` teach nothing."""
    docs = docs.select("doc_id", "text")
    model = fit(docs, label_of(labels, "toxic").where(~held_out("doc_id", modulus, rest)))
    return score(docs, model).select("doc_id", held_out("doc_id", modulus, rest).alias("held_out"), "score", "predicted", "n_passages")
