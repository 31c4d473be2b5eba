"""Quality classifier: regularised quadratic discriminant on transformed document statistics."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from math import log, log1p, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import held_out, labelled_rows, table

_UPPER, _LOWER, _DIGIT = (bytes(range(*r)) for r in ((65, 91), (97, 123), (48, 58)))
_STOP = b".,;:!?"
_SYMBOL = bytes(c for c in range(33, 127) if not (chr(c).isalnum() or chr(c) in ".,;:!?'\"()-"))
_WEB = re.compile(rb"https?://|www\.|@|\.com")

FEATURES = (
    "log_bytes", "log_words", "word_length", "word_length_spread", "upper", "capitalised", "digits", "stops", "exclaim",
    "symbols", "high_bytes", "line_words", "repeated_lines", "distinct_words", "top_word", "short_words", "long_words",
    "repeated_pairs", "web", "symbol_words", "ended_lines", "compression",
)


def statistics(text: str | None) -> list[float]:
    """The FEATURES of one whole text, each transformed (log, square root) towards a bell shape; null counts as empty."""
    b = (text or "").encode("utf-8", "replace")
    n = len(b)
    words = b.split()
    k = len(words)
    lines = [x for x in (y.strip() for y in b.splitlines()) if x]
    if not k:
        return [log1p(n)] + [0.0] * (len(FEATURES) - 1)
    share = lambda chars: sqrt((n - len(b.translate(None, chars))) / n)
    sizes = np.fromiter(map(len, words), dtype=np.float64, count=k)
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    letters = len(b.translate(None, _UPPER))
    cased = n - len(b.translate(None, _LOWER)) + n - letters
    # 64 KiB blocks from the whole text: the compressor's window is 32 KiB, so blocks lose little
    packed = sum(len(zlib.compress(b[i : i + 65536], 1)) for i in range(0, n, 65536))
    return [
        log1p(n), log1p(k), log(sizes.mean()), log1p(sizes.std()), sqrt((n - letters) / max(cased, 1)),
        sqrt(sum(map(bytes.isupper, words)) / k), share(_DIGIT), share(_STOP), share(b"!"), share(_SYMBOL),
        sqrt((n - len(b.decode("utf-8", "replace"))) / n), log1p(k / max(len(lines), 1)),
        sqrt(1 - len(set(lines)) / max(len(lines), 1)), log(len(counts) / k), sqrt(max(counts.values()) / k),
        sqrt(float((sizes <= 3).mean())), sqrt(float((sizes >= 12).mean())), sqrt(1 - pairs / max(k - 1, 1)),
        sqrt(len(_WEB.findall(b)) / k), sqrt(sum(w.translate(None, _SYMBOL) != w for w in words) / k),
        sqrt(sum(x[-1:] in b".!?" for x in lines) / max(len(lines), 1)), log(packed / n),
    ]


@dataclass
class Discriminant:
    """Per class: mean, inverse Cholesky factor of the shrunk covariance (cached), log-determinant and prior."""

    shift: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    offsets: list[float]
    slope: float = 1.0
    bias: float = 0.0
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log density and prior of class 1 minus that of class 0, by Mahalanobis distances."""
        z = (np.clip(x, self.low, self.high) - self.shift) / self.scale
        each = [o - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) for m, f, o in zip(self.means, self.factors, self.offsets)]
        return each[1] - each[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.bias, -500, 500)))


def _densities(x: np.ndarray, y: np.ndarray, shrink: float, pool: float) -> Discriminant:
    shift, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = (x - shift) / scale
    d = z.shape[1]
    covs = [np.cov(z[y == c], rowvar=False, bias=True) if (y == c).sum() > 1 else np.eye(d) for c in (0, 1)]
    share = [max((y == c).mean(), 1e-6) for c in (0, 1)]
    pooled = share[0] * covs[0] + share[1] * covs[1]
    means, factors, offsets = [], [], []
    for c in (0, 1):
        s = (1 - pool) * covs[c] + pool * pooled
        s = (1 - shrink) * s + shrink * max(np.trace(s) / d, 1e-6) * np.eye(d)
        low = np.linalg.cholesky(s)
        means.append(z[y == c].mean(axis=0) if (y == c).any() else np.zeros(d))
        factors.append(np.linalg.inv(low))
        offsets.append(log(share[c]) - np.log(np.diag(low)).sum())
    return Discriminant(shift, scale, means, factors, offsets, low=x.min(axis=0), high=x.max(axis=0))


def _calibration(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias of a logistic curve over the differences, by Newton steps (slope never negative)."""
    unit = max(float(np.std(s)), 1e-9)
    a = np.column_stack([np.clip(s / unit, -8, 8), np.ones_like(s)])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (y - p) - 1e-3 * w)
        w += step
        if abs(step).max() < 1e-9:
            break
    return max(w[0], 0.0) / unit, w[1]


def fit(x: np.ndarray, y: np.ndarray, folds: int = 5) -> Discriminant:
    """Shrinkage is chosen, and the scores calibrated, on out-of-fold differences."""
    if len(y) == 0:
        x, y = np.zeros((1, len(FEATURES))), np.array([1])
    if len(set(y.tolist())) < 2 or min(np.bincount(y, minlength=2)) < folds:
        m = _densities(x, y, 0.5, 0.5)
        m.slope, p = 0.0, (y.sum() + 1) / (len(y) + 2)
        m.bias = log(p / (1 - p))
        return m
    fold = np.arange(len(y)) % folds
    best = None
    for shrink in (0.01, 0.05, 0.2):
        for pool in (0.0, 0.1, 0.4, 0.8):
            s = np.empty(len(y))
            for f in range(folds):
                s[fold == f] = _densities(x[fold != f], y[fold != f], shrink, pool).difference(x[fold == f])
            slope, bias = _calibration(s, y)
            t = np.clip(slope * s + bias, -30, 30)
            loss = float(np.mean(np.logaddexp(0, t) - y * t))
            if best is None or loss < best[0]:
                best = loss, shrink, pool, slope, bias
    m = _densities(x, y, *best[1:3])
    m.slope, m.bias = best[3:]
    return m


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 20_000) -> Discriminant:
    """Fits on at most ``max_rows`` labelled documents outside the held-out fold (their statistics reach the driver)."""
    stats = F.pandas_udf(lambda t: pd.Series([statistics(x) for x in t]), "array<double>")
    rows = labelled_rows(documents, labels, label, max_rows).select("doc_id", stats("text").alias("x"), "label")
    got = rows.toPandas().sort_values("doc_id", kind="stable")
    x = np.array(got["x"].tolist(), dtype=np.float64).reshape(len(got), len(FEATURES))
    return fit(x, got["label"].to_numpy(dtype=np.int64))


def scores(documents: DataFrame, model: Discriminant, text: str = "text", output: str = "score") -> DataFrame:
    """``documents`` with a score column (0 to 1, higher: label 1 likelier). One row out for each row in.

    Null and empty texts are scored as texts of no words; whole texts of any length are read; repeated rows get
    equal scores; other columns are kept, and one already called ``output`` is replaced.
    """

    @F.pandas_udf("double")
    def score(t: pd.Series) -> pd.Series:
        if not len(t):
            return pd.Series([], dtype="float64")
        return pd.Series(model.score(np.array([statistics(x) for x in t])))

    return documents.withColumn(output, score(F.col(text).cast("string")))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(documents, labels)
    scored = scores(documents.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


QUERIES = {"op2_quality": op2_quality}
