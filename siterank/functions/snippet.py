"""Snippets of the final hits.

Choosing the best stretch is a fold over all tokens of a text.  As a lambda it runs
interpreted, several times slower than this small Arrow function, which only ever
sees the few documents that are shown.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html import escape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siterank.functions.stemming import stem

TOKEN = re.compile(r"[^\W_]+")

# Fixed value: longest snippet in characters.
SNIPPET_CHARS = 150


def best_snippet(
    text: str, weights: dict[str, float], stemmed: bool, max_chars: int = SNIPPET_CHARS
) -> str:
    """Best stretch of a text with the terms in ``<b>``, HTML-escaped; '' without a match.

    The text is cut at token borders into stretches of at most ``max_chars``; the
    one with the largest weight of terms wins, the earliest of equals.
    """
    best, current, start, score = (0.0, 0, []), [], None, 0.0
    seen: dict[str, float] = {}
    for match in TOKEN.finditer(text):
        word = match.group()
        weight = seen.get(word)
        if weight is None:
            form = word.lower()
            weight = seen[word] = weights.get(stem(form) if stemmed else form, 0.0)
        if start is None or match.end() - start > max_chars:
            start, score, current = match.start(), 0.0, []
        current.append((match.start(), match.end(), weight > 0))
        score += weight
        if score > best[0]:
            best = (score, start, current)
    parts, at = [], best[1]
    for begin, end, matched in best[2]:
        word = escape(text[begin:end])
        parts += [escape(text[at:begin]), f"<b>{word}</b>" if matched else word]
        at = end
    return "".join(parts)


class Stretches:
    """A text cut into its stretches, whatever is asked: places and term numbers of its tokens, first tokens of the stretches."""

    def __init__(self, text: str, numbers: dict[str, int], stemmed: bool, max_chars: int = SNIPPET_CHARS):
        self.text = text
        spans = [match.span() for match in TOKEN.finditer(text)]
        self.begins, self.ends = [begin for begin, _ in spans], [end for _, end in spans]
        words = [text[begin:end] for begin, end in spans]
        # A term nobody asks for has the last number, and no weight.
        seen = {}
        for word in set(words):
            form = word.lower()
            seen[word] = numbers.get(stem(form) if stemmed else form, len(numbers))
        self.terms = np.array([seen[word] for word in words], np.int64)
        self.cuts, at = [], 0
        while at < len(spans):
            self.cuts.append(at)
            # Up to the first token that ends too far, one token at least.
            at = max(at + 1, bisect_right(self.ends, self.begins[at] + max_chars, at))
        self.cuts.append(at)
        self.stretches = np.repeat(np.arange(len(self.cuts) - 1), np.diff(self.cuts))

    def best(self, weights: np.ndarray) -> str:
        """``best_snippet`` with a weight per term number."""
        if not len(self.terms):
            return ""
        of_token = weights[self.terms]
        # Added up in the order of the tokens.
        scores = np.bincount(self.stretches, of_token)
        best = scores.argmax()
        if not scores[best] > 0:
            return ""
        lo, hi = self.cuts[best], self.cuts[best + 1]
        parts, at = [], self.begins[lo]
        # A token has nothing to escape.
        for i in (lo + np.flatnonzero(of_token[lo:hi] > 0)).tolist():
            begin, end = self.begins[i], self.ends[i]
            parts += [escape(self.text[at:begin]), "<b>", self.text[begin:end], "</b>"]
            at = end
        return "".join([*parts, escape(self.text[at : self.ends[hi - 1]])])


def best_snippets(texts: pa.Array, terms: pa.Array, stemmed: bool) -> pa.Array:
    """``best_snippet`` of every text and its terms; a text that comes again is read once."""
    encoded = texts.fill_null("").dictionary_encode()
    of_row, distinct = encoded.indices.to_numpy(), encoded.dictionary
    asked = terms.flatten()
    names = asked.field("term").dictionary_encode()
    numbers = {name: i for i, name in enumerate(names.dictionary.to_pylist())}
    codes, weights = names.indices.to_numpy(), asked.field("weight").to_numpy(zero_copy_only=False)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(terms), 0).to_numpy())
    held = np.zeros(len(numbers) + 1)
    out, text, number = [""] * len(texts), None, -1
    for row in np.argsort(of_row, kind="stable").tolist():
        if of_row[row] != number:
            number = of_row[row]
            text = Stretches(distinct[number].as_py(), numbers, stemmed)
        mine = slice(ends[row - 1] if row else 0, ends[row])
        held[codes[mine]] = weights[mine]
        out[row] = text.best(held)
        held[codes[mine]] = 0
    return pa.array(out, pa.string())


def snippet_udf(stemmed: bool):
    """``(text, array<struct<term, weight>>) -> snippet``."""

    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array, terms: pa.Array) -> pa.Array:
        return best_snippets(texts, terms, stemmed)

    return run
