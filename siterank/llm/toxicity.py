"""Toxicity by class-conditional Kneser-Ney models of the letters of words.

Each class has its own counts of letter sequences of the highest order; where they end,
both back off to one shared model of shorter sequences, whose counts are the numbers of
different letters they follow (Kneser-Ney).  A rare expression, or an inflected form
that was never seen, is thus smoothed by what all text has in common and by the
sequences it shares with known ones.  A toxic text is mostly ordinary words with a few
toxic ones in between, so the toxic likelihood of a word mixes both models.  The
score compares the two log-likelihoods per word.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siterank.llm.tables import WORD, slices

WORDS = re.compile(WORD)
EDGES = '.,;:!?#$%&*|<>"()[]{}\''
#: Marks the start of a word.
START = "\x02"
#: Distinct words a worker remembers; beyond it starts afresh.
REMEMBER = 1_000_000
STEP = np.uint64(0x9E3779B97F4A7C15)
DISCOUNT = 0.75


def plain(word: str) -> str:
    return word.lower().strip(EDGES)


class Letters:
    """The letter sequences of many words: for every place the hash of the last k letters."""

    def __init__(self, words: list[str]):
        codes = np.frombuffer((START + START.join(words)).encode("utf-32-le", "surrogatepass"), np.uint32)
        # A start mark inside a word would look like the next word.
        self.codes = codes.astype(np.uint64)
        sizes = np.array([len(w) + 1 for w in words])
        self.owner = np.repeat(np.arange(len(words)), sizes)
        self.place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.inner = self.place > 0

    def last(self, k: int) -> np.ndarray:
        h = np.zeros(len(self.codes), np.uint64)
        for j in range(k):
            shifted = np.concatenate([np.zeros(j, np.uint64), self.codes[: len(self.codes) - j]]) if j else self.codes
            h = np.where(self.place >= j, h * STEP + shifted + np.uint64(1), h)
        return h


def before(hashes: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), hashes[:-1]])


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted keys in a sorted array, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, back = np.unique(keys, return_inverse=True)
    return found, np.bincount(back, weights, len(found))


@dataclass
class Level:
    """One order of a model: discounted shares of sequences, and what a history leaves to the lower order."""

    grams: np.ndarray
    shares: np.ndarray
    histories: np.ndarray
    backoff: np.ndarray

    @staticmethod
    def count(grams: np.ndarray, histories: np.ndarray, weights: np.ndarray) -> "Level":
        keys, counts = summed(grams, weights)
        first = np.full(len(keys), 0, np.uint64)
        first[np.searchsorted(keys, grams)] = histories
        seen, total = summed(first, counts)
        _, kept_back = summed(first, np.minimum(counts, DISCOUNT))
        shares = np.maximum(counts - DISCOUNT, 0) / total[np.searchsorted(seen, first)]
        return Level(keys, shares, seen, kept_back / total)

    def apply(self, grams: np.ndarray, histories: np.ndarray, lower: np.ndarray) -> np.ndarray:
        at, there = find(self.grams, grams)
        own = np.where(there, self.shares[at], 0.0) if len(self.grams) else np.zeros(len(grams))
        at, there = find(self.histories, histories)
        rest = np.where(there, self.backoff[at], 1.0) if len(self.histories) else np.ones(len(grams))
        return own + rest * lower


@dataclass
class ToxicityModel:
    order: int = 5
    mixed: float = 0.01
    shared: list[Level] = field(default_factory=list)
    classes: list[Level] = field(default_factory=list)
    slope: float = 0.0
    level: float = float("-inf")
    #: Tells models apart, so that a worker keeps what it knows between tasks.
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of every word under the toxic mixture, less that under the ordinary model."""
        if not words or not self.classes:
            return np.zeros(len(words))
        letters = Letters(words)
        hashes = [letters.last(k) for k in range(self.order + 1)]
        lower = np.full(len(letters.codes), 1 / 4096)
        for k, level in enumerate(self.shared, 1):
            lower = level.apply(hashes[k], before(hashes[k - 1]), lower)
        top, history = hashes[self.order], before(hashes[self.order - 1])
        ordinary, toxic = [np.log(level.apply(top, history, lower)) for level in self.classes]
        lead = np.bincount(letters.owner, np.where(letters.inner, toxic - ordinary, 0.0), len(words))
        return np.logaddexp(np.log1p(-self.mixed), np.log(self.mixed) + lead)

    def probability(self, means: np.ndarray) -> np.ndarray:
        z = self.slope * spread(means) + self.level
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def spread(means: np.ndarray) -> np.ndarray:
    """Means on a scale that is linear near zero and logarithmic beyond."""
    return np.arcsinh(np.asarray(means) / 0.005)


def build(grams: list[str], ordinary: list[float], toxic: list[float], order: int, mixed: float) -> ToxicityModel:
    """The model from the counts of letter sequences of the highest order (shorter at word starts)."""
    model = ToxicityModel(order, mixed)
    counts = np.array([ordinary, toxic], float)
    lengths = np.array([len(g) for g in grams])
    codes = np.zeros((len(grams), order), np.uint64)
    for k in range(order):
        # Letter k from the end; sequences shorter than that stop there.
        codes[:, k] = [ord(g[-1 - k]) + 1 if len(g) > k else 0 for g in grams]

    def hashed(first: int, last: int) -> np.ndarray:
        h = np.zeros(len(grams), np.uint64)
        for k in range(first, last):
            h = np.where(lengths > k, h * STEP + codes[:, k], h)
        return h

    # Sequences of k letters, counted by the different longer ones they end.
    for k in range(1, order):
        longer, at = np.unique(hashed(0, k + 1), return_index=True)
        model.shared.append(Level.count(hashed(0, k)[at], hashed(1, k)[at], np.ones(len(longer))))
    for c in counts:
        seen = c > 0
        model.classes.append(Level.count(hashed(0, order)[seen], hashed(1, order)[seen], c[seen]))
    return model


def calibrate(model: ToxicityModel, means: np.ndarray, labels: np.ndarray, decay: float = 0.02) -> None:
    """A logistic curve over the spread means by Newton's method; the slope is never negative."""
    x = np.stack([spread(means), np.ones(len(means))], 1)
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        grad = x.T @ (labels - p) - decay * w * [1, 0]
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag([decay, 1e-6])
        w = w + np.clip(np.linalg.solve(hess, grad), -2, 2)
    model.slope, model.level = max(float(w[0]), 0.0), float(w[1])


def fold(doc_id: str = "doc_id") -> Column:
    """Remainder by five of the CRC-32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, rows: int = 20_000, order: int = 5, mixed: float = 0.01
) -> ToxicityModel:
    """Train on labelled rows whose fold is not 0, the ``rows`` first by hashed id (a documented bound).

    Fold 1 sets the curve from means to scores, the others give the counts: in how many
    documents of a class a word stands, spread over its letter sequences.  Words and
    sequences are summed up by Spark; the driver gets one row per sequence of the
    bounded sample.  Without both classes every score is the share of toxic rows.
    """
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold() != 0))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("_toxic"))
        .orderBy(F.xxhash64("doc_id"))
        .limit(rows)
    )
    # At most ``rows`` ids: safe to broadcast at any size of the tables.
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("_fold", fold())

    def words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames, "text"):
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(frame["text"], frame["_toxic"]):
                counts[toxic].update({plain(w) for w in WORDS.findall(text or "")})
            every = list(counts[0].keys() | counts[1].keys())
            yield pd.DataFrame({"word": every, "c0": [counts[0][w] for w in every], "c1": [counts[1][w] for w in every]})

    known = sample.filter("_fold <> 1").select("text", "_toxic").mapInPandas(words, "word string, c0 long, c1 long")
    known = known.groupBy("word").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).filter("word <> ''")
    marked = F.concat(F.lit(START), F.col("word"))
    ends = F.sequence(F.lit(2), F.length("word") + 1)
    grams = F.transform(
        ends, lambda e: F.substring(marked, F.greatest(F.lit(1), e - order + 1), F.least(F.lit(order), e))
    )
    sums = (
        known.select(F.explode(grams).alias("gram"), "c0", "c1")
        .groupBy("gram")
        .agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
        .toPandas()
        .sort_values("gram")
    )
    if not (sums["c0"].sum() and sums["c1"].sum()):
        toxic = float(sums["c1"].sum() > 0)
        return ToxicityModel(order, mixed, level=700.0 if toxic else -700.0)
    model = build(sums["gram"].tolist(), sums["c0"].tolist(), sums["c1"].tolist(), order, mixed)
    held = score_rows(sample.filter("_fold = 1"), model).select("_mean", "_toxic").toPandas()
    if len(held) == 0 or held["_toxic"].nunique() < 2:
        model.slope, model.level = 1.0, -float(spread(0.05))
    else:
        calibrate(model, held["_mean"].to_numpy(), held["_toxic"].to_numpy(float))
    return model


_REMEMBERED: dict[str, dict[str, float]] = {}


def remembered(key: str) -> dict[str, float]:
    """The word scores this worker process knows of a model; those of others are forgotten."""
    if key not in _REMEMBERED:
        _REMEMBERED.clear()
        _REMEMBERED[key] = {}
    return _REMEMBERED[key]


def score_rows(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """Add ``_mean``, the log-likelihood ratio per word of the whole text; 0 without words."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]) + ", _mean double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = remembered(model.key)
        for frame in slices(frames, text, 4 << 20):
            split = [WORDS.findall(t or "") for t in frame[text].tolist()]
            wanted = set().union(*split)
            if len(known) + len(wanted) > REMEMBER:
                known.clear()
            new = list(wanted - known.keys())
            known.update(zip(new, model.word_scores([plain(w) for w in new]).tolist()))
            look = known.__getitem__
            yield frame.assign(_mean=[sum(map(look, words)) / len(words) if words else 0.0 for words in split])

    return docs.mapInPandas(run, schema)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) to every row.

    The score depends on the text alone.  Null and empty texts have no words and get
    the score of a mean of 0.  Rows repeat as they came, columns of the added names are
    replaced.  One pass without a shuffle; the model has the size of its sample.
    """
    docs = docs.drop(*[c for c in ("score", "predicted", "_mean") if c in docs.columns])
    slope, level = model.slope, model.level
    z = F.asinh(F.col("_mean") / 0.005) * F.lit(slope) + F.lit(level)
    scored = score_rows(docs, model, text).withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), z)))))
    return scored.drop("_mean").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
