"""Quality rules: counts over whole texts, and lines labelled by a conditional random field.

Every line is content or boilerplate.  A linear-chain conditional random field scores
the labels of a line by its features and those of neighbouring lines by their pair;
Viterbi decoding finds the best sequence, and a document stays when enough of its
characters lie in content lines.  The field is trained here, on a bounded sample of
labelled documents whose label counts for each of their lines.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siterank.llm.tables import WORD, slices

WORDS = re.compile(WORD)
SYMBOLS = re.compile(r"[#*$%&|<>]")
SENTENCE_END = (".", "!", "?", "…", '."', ".)", ":", ";")
N_FEATURES = 14
COLUMNS = {
    "n_words": "bigint",
    "word_chars": "bigint",
    "n_symbols": "bigint",
    "n_dup_lines": "bigint",
    "n_repeat_words": "bigint",
    "base_failed": "boolean",
    "content_share": "double",
    "kept": "boolean",
}


def repeat_words(words: list[str]) -> int:
    """Words inside three-word windows that the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total, end = 0, 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def dup_lines(lines: list[str]) -> int:
    """Lines with a word that are equal to an earlier line of the text."""
    counts = Counter(lines)
    return sum(n - 1 for line, n in counts.items() if n > 1 and WORDS.search(line))


def line_features(lines: list[str]) -> list[int]:
    """The features of every line as the bits of one number; the first is always set."""
    counts = Counter(lines)
    out = []
    for line in lines:
        chars = len(line)
        words = line.count(" ") + 1
        symbols = len(SYMBOLS.findall(line))
        bars = line.count("|")
        spread = chars / words
        bits = 1
        if chars == 0:
            bits |= 2
        elif words <= 2:
            bits |= 4
        elif words <= 6:
            bits |= 8
        elif words >= 25:
            bits |= 16
        if symbols:
            bits |= 32
            if symbols * 50 > chars:
                bits |= 64
            if symbols * 10 > chars:
                bits |= 128
        if bars * 6 > words:
            bits |= 256
        if line.endswith(SENTENCE_END):
            bits |= 512
        if spread > 7.5:
            bits |= 1024
        elif spread < 3:
            bits |= 2048
        if counts[line] > 1:
            bits |= 4096
        if line[:1].isupper():
            bits |= 8192
        out.append(bits)
    return out


def unpack(masks: np.ndarray) -> np.ndarray:
    return (masks[..., None] >> np.arange(N_FEATURES) & 1).astype(float)


@dataclass
class LineModel:
    """Weights of the field: features by label, and label pairs; label 1 is content."""

    emit: list[list[float]] = field(default_factory=lambda: [[0.0] * N_FEATURES] * 2)
    pair: list[list[float]] = field(default_factory=lambda: [[0.0, 0.0], [0.0, 0.0]])

    def lead(self, mask: int) -> float:
        """How much the features of a line speak for content."""
        return sum((self.emit[1][k] - self.emit[0][k]) for k in range(N_FEATURES) if mask >> k & 1)

    def decode(self, masks: list[int], leads: dict[int, float]) -> list[bool]:
        """The best sequence of labels (Viterbi); of equal sequences the one with more content at the end."""
        (p00, p01), (p10, p11) = self.pair
        zero, one = 0.0, 0.0
        back: list[tuple[bool, bool]] = []
        for i, mask in enumerate(masks):
            lead = leads.get(mask)
            if lead is None:
                lead = leads[mask] = self.lead(mask)
            if i:
                to0, to1 = one + p10 >= zero + p00, one + p11 >= zero + p01
                back.append((to0, to1))
                zero, one = (one + p10 if to0 else zero + p00), (one + p11 if to1 else zero + p01)
            one += lead
        label = one >= zero
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1]


def train(sequences: list[list[int]], labels: list[int], steps: int = 150, decay: float = 1e-3) -> LineModel:
    """Maximum likelihood with quadratic decay, by forward and backward sums over all sequences at once.

    Every document weighs the same however many lines it has.  Without both labels
    there is nothing to tell apart: all weights stay zero and every line is content.
    """
    known = [(s, y) for s, y in zip(sequences, labels) if s]
    if len({y for _, y in known}) < 2:
        return LineModel()
    known.sort(key=lambda x: -len(x[0]))
    sizes = np.array([len(s) for s, _ in known])
    gold = np.array([y for _, y in known])
    flat = np.concatenate([np.array(s) for s, _ in known])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    masks, kind = np.unique(flat, return_inverse=True)
    feats = unpack(masks)
    # Both labels weigh the same in sum.
    weight = 1.0 / sizes / np.where(gold == 1, (gold == 1).sum(), (gold == 0).sum())
    live = [int((sizes > t).sum()) for t in range(int(sizes[0]))]
    emit, pair = np.zeros((2, N_FEATURES)), np.zeros((2, 2))
    speed = [np.zeros_like(emit), np.zeros_like(pair)]
    for step in range(steps):
        scores = feats @ emit.T
        alpha, beta = np.zeros((len(flat), 2)), np.zeros((len(flat), 2))
        for t, n in enumerate(live):
            here = starts[:n] + t
            alpha[here] = scores[kind[here]]
            if t:
                alpha[here] += np.logaddexp.reduce(alpha[here - 1][:, :, None] + pair, axis=1)
        for t in range(len(live) - 1, 0, -1):
            here = starts[: live[t]] + t
            beta[here - 1] = np.logaddexp.reduce(pair + (scores[kind[here]] + beta[here])[:, None, :], axis=2)
        last = starts + sizes - 1
        total = np.logaddexp.reduce(alpha[last], axis=1)
        owner = np.repeat(np.arange(len(known)), sizes)
        marginal = np.exp(alpha + beta - total[owner][:, None])
        truth = np.eye(2)[gold[owner]]
        error = (truth - marginal) * weight[owner][:, None]
        by_mask = np.stack([np.bincount(kind, error[:, y], len(masks)) for y in (0, 1)])
        grad_emit = by_mask @ feats - decay * emit
        inner = np.ones(len(flat), bool)
        inner[starts] = False
        j = np.flatnonzero(inner)
        both = np.exp(
            alpha[j - 1][:, :, None] + pair + (scores[kind[j]] + beta[j])[:, None, :] - total[owner[j]][:, None, None]
        )
        want = truth[j - 1][:, :, None] * truth[j][:, None, :]
        grad_pair = ((want - both) * weight[owner[j]][:, None, None]).sum(0) - decay * pair
        for value, grad, s in ((emit, grad_emit, speed[0]), (pair, grad_pair, speed[1])):
            s *= 0.9
            s += grad
            value += 0.5 * s
    return LineModel(emit.tolist(), pair.tolist())


def fit_line_model(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = 3000) -> LineModel:
    """Train on the ``rows`` labelled documents whose hashed ids come first (a documented bound).

    ``labels`` is ``(doc_id, label)``; rows with null in either are left out, and so are
    documents that fail the base rules, which the field need not know.  Only the features
    of that many documents come to the driver, as one number per line.
    """
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max(label).alias("_label"))
        .orderBy(F.xxhash64("doc_id"))
        .limit(rows)
    )
    texts = docs.select("doc_id", F.col("text").alias("text")).filter("text is not null")

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lines = [t.split("\n") for t in frame["text"]]
            passed = [not base_counts(t, x)[-1] for t, x in zip(frame["text"], lines)]
            frame = frame[passed].assign(masks=[line_features(x) for x, ok in zip(lines, passed) if ok])
            yield frame[["doc_id", "_label", "masks"]]

    # At most ``rows`` ids: safe to broadcast at any size of the tables.
    found = texts.join(F.broadcast(chosen), "doc_id").mapInPandas(features, "doc_id long, _label int, masks array<int>")
    sample = sorted((r["doc_id"], r["_label"], list(r["masks"])) for r in found.collect())
    return train([s for _, _, s in sample], [y for _, y, _ in sample])


def base_counts(text: str, lines: list[str]) -> tuple:
    """The counts of the base rules and whether one of them fails."""
    words = WORDS.findall(text)
    n_words, repeated = len(words), repeat_words(words)
    failed = n_words < 50 or 100 * repeated > 50 * n_words
    return n_words, sum(map(len, words)), len(SYMBOLS.findall(text)), dup_lines(lines), repeated, failed


def judge(text: str, model: LineModel, leads: dict[int, float], least_share: float) -> tuple:
    lines = text.split("\n")
    base = base_counts(text, lines)
    labels = model.decode(line_features(lines), leads)
    chars = sum(map(len, lines))
    share = sum([len(line) for line, content in zip(lines, labels) if content]) / chars if chars else 0.0
    return (*base, share, not base[-1] and share >= least_share)


def quality_rules(docs: DataFrame, model: LineModel, text: str = "text", least_share: float = 0.5) -> DataFrame:
    """Add the counts, ``base_failed``, ``content_share`` and ``kept`` to every row.

    A null text has no words: its counts are 0 and it is not kept.  Rows repeat as they
    came; columns of the added names are replaced, all others stay.  One pass without
    a shuffle; a worker holds a slice of texts at a time.
    """
    docs = docs.drop(*[c for c in COLUMNS if c in docs.columns])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema])
    schema += "".join([f", {name} {kind}" for name, kind in COLUMNS.items()])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leads: dict[int, float] = {}
        for frame in slices(frames, text, 2 << 20):
            found = [judge(t or "", model, leads, least_share) for t in frame[text].tolist()]
            yield frame.assign(**{name: list(values) for name, values in zip(COLUMNS, zip(*found))})

    return docs.mapInPandas(run, schema)
