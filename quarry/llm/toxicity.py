"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is (noisy-or)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from math import exp, log1p

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import fresh, held_out, labelled_rows, stored, table

_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*|[.!?]+")
_WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Character spans of the sentences of a whole text (none for null, empty or blank texts)."""
    return [m.span() for m in _SENTENCE.finditer(text or "") if not m.group().isspace()]


def words(sentence: str) -> list[str]:
    return _WORD.findall(sentence.lower())


def features(word: str) -> list[str]:
    """A word and its proper prefixes of 4 to 7 letters (marked by a star), which stand for its inflected forms."""
    return [word, *(word[:k] + "*" for k in range(4, min(8, len(word))))]


@dataclass
class NoisyOr:
    """A sentence's probability is logistic in the summed weights of its distinct features; a document's is noisy-or."""

    bias: float = -6.0
    weights: dict[str, float] = field(default_factory=dict)
    #: Features with a weight, by word; emptied when it holds MEMO words, so memory is bounded.
    memo: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)

    MEMO = 300_000

    def _known(self, sentence: str) -> set[str]:
        memo, found = self.memo, set()
        for w in _WORD.findall(sentence):
            f = memo.get(w)
            if f is None:
                if len(memo) >= self.MEMO:
                    memo.clear()
                f = memo[w] = tuple(x for x in features(w) if x in self.weights)
            if f:
                found.update(f)
        return found

    def _logit(self, sentence: str) -> float:
        return self.bias + sum(self.weights[w] for w in sorted(self._known(sentence.lower())))

    def document(self, text: str | None) -> float:
        """1 - product of (1 - p) over sentences; 0 for a text without sentences."""
        if not text:
            return 0.0
        s, hits, kept = text.lower(), 0, 0.0
        get, spans = self.weights.__getitem__, 0
        for m in _SENTENCE.finditer(s):
            if found := self._known(m.group()):
                kept -= _softplus(self.bias + sum(map(get, sorted(found))))
                hits += 1
            spans += not m.group().isspace()
        kept -= (spans - hits) * _softplus(self.bias)
        return 1 - exp(kept)

    def offending(self, text: str | None, at_least: float = 0.5) -> list[tuple[int, int, float]]:
        """(start, end, probability) of the sentences whose own probability is at least ``at_least``."""
        scored = ((a, b, 1 / (1 + exp(-max(-500.0, min(500.0, self._logit(text[a:b])))))) for a, b in sentences(text))
        return [x for x in scored if x[2] >= at_least]


def _softplus(x: float) -> float:
    return x if x > 30 else log1p(exp(x))


def fit(bags: list[list[list[int]]], plain: list[int], y: np.ndarray, n_words: int, steps: int = 300, l2: float = 2e-5, l1: float = 4e-5) -> tuple[float, np.ndarray]:
    """Bias and weights from document labels. bags: per document its sentences with known words, as word numbers; plain:
    the number of its other sentences. Proximal Adam on the noisy-or likelihood; the L1 part leaves neutral words at 0."""
    flat = [ids for bag in bags for ids in bag]
    word = np.array([i for ids in flat for i in ids], dtype=np.int64)
    return fit_flat(np.array([len(bag) for bag in bags]), np.array([len(ids) for ids in flat], dtype=np.int64), word, np.array(plain), y, n_words, steps, l2, l1)


def fit_flat(counts: np.ndarray, sizes: np.ndarray, word_: np.ndarray, plain: np.ndarray, y: np.ndarray, n_words: int, steps: int = 300, l2: float = 2e-5, l1: float = 4e-5) -> tuple[float, np.ndarray]:
    """``fit`` on flat arrays: ``counts`` sentences a document, ``sizes`` words a sentence, the words' numbers."""
    n, s, plain_ = len(y), len(sizes), plain.astype(np.float64)
    doc_, sent_ = np.repeat(np.arange(n), counts), np.repeat(np.arange(s), sizes)
    w, b = np.zeros(n_words), -5.0
    m, v = np.zeros(n_words + 1), np.zeros(n_words + 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(sent_, weights=w[word_], minlength=s)
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-b))
        kept = -(np.bincount(doc_, weights=np.logaddexp(0, z), minlength=n) + plain_ * np.logaddexp(0, b))  # log of 1 - p(document)
        # derivative of the negative likelihood by each sentence's logit: p for clean documents, -p(1-q)/q for toxic ones
        k = np.where(y == 1, -np.exp(kept) / np.maximum(-np.expm1(kept), 1e-9), 1.0)
        gs = p * k[doc_] / n
        g = np.append(np.bincount(word_, weights=gs[sent_], minlength=n_words) + 2 * l2 * w, gs.sum() + (k * plain_).sum() * p0 / n)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        rate = 0.2 * (1 - 0.9 * t / steps)
        size = rate / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        step = size * m / (1 - 0.9**t)
        w = w - step[:-1]
        w = np.sign(w) * np.maximum(np.abs(w) - l1 * size[:-1], 0)
        b = float(b - step[-1])
    return b, w


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = 20_000, least_lean: float = 4.0) -> NoisyOr:
    """Fits on at most ``max_rows`` labelled documents outside the held-out fold.

    Word counts by label are taken over all of those rows. Every word and prefix whose share of toxic documents is off that
    of all documents by ``least_lean`` standard deviations (after a continuity correction of half a document) is a feature,
    however many there are; the others are what chance gives. Without labels of both kinds the model calls nothing toxic.
    """

    @F.pandas_udf("array<array<string>>")
    def bag(t: pd.Series) -> pd.Series:
        return pd.Series([[sorted({f for w in set(words(x[a:b])) for f in features(w)}) for a, b in sentences(x)] for x in t.fillna("")])

    rows = stored(labelled_rows(documents, labels, label, max_rows).select("doc_id", bag("text").alias("bag"), "label"), "toxic-train")
    total = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        return NoisyOr()
    share = total.get(1, 0) / sum(total.values())
    seen = rows.select("label", F.explode(F.array_distinct(F.flatten("bag"))).alias("word"))
    counts = seen.groupBy("word").agg(F.count("*").alias("n"), F.sum("label").alias("k"))
    lean = (F.abs(F.col("k") - share * F.col("n")) - 0.5) / F.sqrt(F.col("n") * share * (1 - share))
    picked = [r["word"] for r in counts.where(lean >= least_lean).orderBy("word").collect()]  # words of max_rows texts
    number = {w: i for i, w in enumerate(picked)}
    shared = rows.sparkSession.sparkContext.broadcast(number)

    @F.pandas_udf("struct<words binary, sizes binary, plain int>")
    def known(bags: pd.Series) -> pd.DataFrame:
        """Word numbers and words a sentence as packed ints: nested lists would take the driver many times their bytes."""
        get, packed = shared.value.get, lambda x: np.array(x, dtype=np.int32).tobytes()
        out = [[[i for w in s if (i := get(w)) is not None] for s in x] for x in bags]
        held = [[s for s in x if s] for x in out]
        return pd.DataFrame({"words": [packed([i for s in x for i in s]) for x in held], "sizes": [packed([len(s) for s in x]) for x in held], "plain": [len(x) - len(y) for x, y in zip(out, held)]})

    got = rows.select("doc_id", known("bag").alias("k"), "label").select("doc_id", "k.*", "label").toArrow().sort_by("doc_id")
    sizes = got["sizes"].to_pylist()
    unpacked = lambda x: np.frombuffer(b"".join(x), dtype=np.int32).astype(np.int64)
    held = np.array([len(x) // 4 for x in sizes])
    b, w = fit_flat(held, unpacked(sizes), unpacked(got["words"].to_pylist()), got["plain"].to_numpy(), got["label"].to_numpy(), len(picked))
    return NoisyOr(b, {x: float(w[i]) for x, i in number.items() if w[i] != 0})


def scores(documents: DataFrame, model: NoisyOr, text: str = "text", output: str = "score") -> DataFrame:
    """``documents`` with the noisy-or probability of each whole text. One row out for each row in.

    Null, empty and blank texts score 0; repeated rows score alike; other columns are kept, one called ``output`` replaced.
    """
    score = F.pandas_udf(lambda t: pd.Series([model.document(x) for x in t], dtype="float64"), "double")
    return documents.withColumn(output, score(F.col(text).cast("string")))


def clean(documents: DataFrame, model: NoisyOr, below: float = 0.5) -> DataFrame:
    """The rows of ``documents`` whose score stays under ``below``, with their columns as they were."""
    name = fresh(documents, "score")
    return scores(documents, model, output=name).where(F.col(name) < below).drop(name)


def locate(documents: DataFrame, model: NoisyOr, text: str = "text", output: str = "offending", at_least: float = 0.5) -> DataFrame:
    """``documents`` with an array of the offending sentences: start, end (characters) and probability."""

    @F.pandas_udf("array<struct<start: int, end: int, probability: double>>")
    def spans(t: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b, "probability": p} for a, b, p in model.offending(x, at_least)] for x in t.fillna("")])

    return documents.withColumn(output, spans(F.col(text).cast("string")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(documents, labels)
    scored = scores(documents.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


QUERIES = {"op8_toxicity": op8_toxicity}
