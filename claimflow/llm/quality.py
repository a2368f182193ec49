"""Quality classifier: regularised quadratic discriminant over document statistics.

Each class is a normal distribution of the transformed statistics whose
covariance is shrunk towards the pooled covariance and towards a multiple of
the identity. A score is the difference of the two log densities, taken from
Mahalanobis distances with Cholesky factors that are computed once and shipped
inverted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import need, small_batches

#: Labelled rows that the fit uses at most; drawn by a hash of doc_id.
MOST_LABELLED = 40_000

FEATURES = ("chars", "words", "word_len", "word_len_sd", "upper", "digits", "punct", "symbols", "pipes", "bangs", "high", "spaces", "lines", "line_len", "distinct", "top_word", "repeats", "run", "commas", "stops", "caps_words", "short_words", "symbol_ends", "quotes")

_UPPER, _DIGIT, _SPACE = (np.array([f(bytes([i])) for i in range(256)]) for f in (bytes.isupper, bytes.isdigit, bytes.isspace))
_LOWER = np.array([bytes([i]).islower() for i in range(256)])
_HIGH = np.arange(256) >= 128
_PUNCT = ~(_UPPER | _LOWER | _DIGIT | _SPACE | _HIGH)
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#$%&*@^~_=+<>{}[]\\/", np.uint8))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text, in the order of FEATURES; all 0 for an empty text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, lengths = len(data), np.fromiter(map(len, words), np.int64, len(words))
    m = len(words)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    same = np.fromiter((a == b for a, b in zip(words, words[1:])), bool, m - 1) if m > 1 else np.zeros(0, bool)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
    run = int((edges[1::2] - edges[::2]).max()) if len(edges) else 0
    part = lambda mask: float(np.sqrt(count[mask].sum() / n))
    ends = sum(w[-1] in b"#$%&*!|" for w in words)
    return [
        np.log1p(n),
        np.log1p(m),
        float(np.log(lengths.mean())),
        float(np.log1p(lengths.std())),
        part(_UPPER),
        part(_DIGIT),
        part(_PUNCT),
        part(_SYMBOL),
        float(np.sqrt(count[124] / n)),
        float(np.sqrt(count[33] / n)),
        part(_HIGH),
        part(_SPACE),
        float(np.log1p(count[10])),
        float(np.log(n / (count[10] + 1))),
        len(seen) / m,
        float(np.sqrt(max(seen.values()) / m)),
        float(np.sqrt(same.mean())) if m > 1 else 0.0,
        float(np.log1p(run)),
        float(np.sqrt(count[44] / m)),
        float(np.sqrt(count[46] / m)),
        float(np.sqrt(sum(w.isupper() for w in words) / m)),
        float(np.sqrt((lengths <= 3).mean())),
        float(np.sqrt(ends / m)),
        float(np.sqrt(count[34] / m)),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x array<double>): the statistics of every row, over its whole text."""
    small_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, "doc_id long, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Log-odds of class 1: bias - |x - mean1|^2 / 2 + |x - mean0|^2 / 2 in whitened coordinates."""

    means: np.ndarray
    whiten: np.ndarray
    bias: float
    scale: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        if not len(self.means):
            return np.full(len(x), self.bias)
        d = [(((x - mean) @ white.T) ** 2).sum(1) for mean, white in zip(self.means, self.whiten, strict=True)]
        return self.scale * (self.bias + (d[0] - d[1]) / 2)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.log_odds(x), -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, to_pooled: float | None = None, to_identity: float | None = None) -> Discriminant:
    """Fits the discriminant. Shrinkages that are not given are chosen on a fifth of the rows.

    With one class only (or fewer than 5 rows of one) every score is the share of class 1, or 0.5 without rows.
    """
    y = y.astype(int)
    if min((y == 0).sum(), (y == 1).sum()) < 5:
        share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        return Discriminant(np.empty((0, 0)), np.empty((0, 0)), float(np.log(share / (1 - share))), 1.0)
    if to_pooled is None or to_identity is None:
        held = np.arange(len(y)) % 5 == 0
        grid = [(a, b) for a in (0.0, 0.1, 0.3, 0.6) for b in (1e-3, 1e-2, 5e-2, 0.2)]
        if min(np.bincount(y[~held], minlength=2)) >= 5 and held.any():

            def loss(ab: tuple[float, float]) -> float:
                z = fit(x[~held], y[~held], *ab).score(x[held])
                return float(((z >= 0.5) != y[held]).mean() + 0.01 * ((z - y[held]) ** 2).mean())

            to_pooled, to_identity = min(grid, key=loss)
        else:
            to_pooled, to_identity = 0.3, 0.05
    centre, spread = x.mean(0), x.std(0) + 1e-6
    z = (x - centre) / spread
    means = [z[y == k].mean(0) for k in (0, 1)]
    covs = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    share = y.mean()
    pooled = (1 - share) * covs[0] + share * covs[1]
    white, logs = [], []
    for c in covs:
        c = (1 - to_pooled) * c + to_pooled * pooled
        c = (1 - to_identity) * c + to_identity * max(np.trace(c) / len(c), 1e-6) * np.eye(len(c))
        factor = np.linalg.cholesky(c)
        white.append(np.linalg.inv(factor) / spread)
        logs.append(2 * np.log(np.diag(factor)).sum())
    bias = float(np.log(share / (1 - share)) + (logs[0] - logs[1]) / 2)
    return Discriminant(np.array([centre + m * spread for m in means]), np.array(white), bias, 1.0)


def labelled(docs: DataFrame, labels: DataFrame, learn: Column | None, most: int = MOST_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``most`` labelled documents; ``learn`` (over doc_id) says which labels may be learned.

    The sample's ids are bounded by ``most``, so they are broadcast and no text is shuffled.
    """
    one = labels.where("quality is not null and doc_id is not null").where(F.lit(True) if learn is None else learn)
    one = one.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    said = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).toPandas()
    if not len(said):
        return np.empty((0, len(FEATURES))), np.empty(0, int)
    ids = docs.sparkSession.createDataFrame(said[["doc_id"]])
    some = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(ids), "doc_id", "left_semi")
    # A doc_id that comes several times counts with one of its texts: as many rows as sampled ids reach the driver.
    rows = document_statistics(some).groupBy("doc_id").agg(F.min("x").alias("x")).toPandas().merge(said, on="doc_id").sort_values("doc_id")
    return np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES)), rows["y"].to_numpy()


def score_quality(docs: DataFrame, labels: DataFrame, learn: Column | None = None, most: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, score) for every row of ``docs`` (doc_id, text; other columns are ignored).

    ``labels`` has doc_id and quality (0/1; null rows are skipped, several rows
    of a doc_id vote). ``learn`` bounds which labels the fit sees. Score is the
    probability of quality 1, from the text alone; null text counts as empty.
    Rows that repeat are scored each; an empty table gives no rows. With labels
    of one class or none the score is the same for all rows (see :func:`fit`).
    """
    need(docs, ["doc_id", "text"])
    need(labels, ["doc_id", "quality"])
    model = docs.sparkSession.sparkContext.broadcast(fit(*labelled(docs, labels, learn, most)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t.as_py()) for t in b.column(1)], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.value.score(x))], ["doc_id", "score"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, learn: Column | None = None, most: int = MOST_LABELLED, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns (see :func:`score_quality`).

    The statistics and the decision are made next to each text, so no text is shuffled.
    """
    need(docs, ["doc_id", "text"])
    need(labels, ["doc_id", "quality"])
    model = docs.sparkSession.sparkContext.broadcast(fit(*labelled(docs, labels, learn, most)))
    small_batches(docs.sparkSession)

    @F.pandas_udf("boolean")
    def good(text: pd.Series) -> pd.Series:
        x = np.array([statistics(t) for t in text], float).reshape(-1, len(FEATURES))
        return pd.Series(model.value.score(x) >= threshold)

    return docs.where(good("text"))
