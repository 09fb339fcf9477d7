"""Packing documents into fixed-length training sequences by harmonic classes.

A document's ids are cut into pieces of at most ``capacity`` ids: full pieces from its
start and one remainder.  A piece of ``length`` ids falls into class
``k = capacity // length``, that is ``capacity / (k + 1) < length <= capacity / k``,
and every sequence of class k holds exactly k pieces of that class (the last one of a
class possibly fewer), so it never overflows and is at least ``k / (k + 1)`` full.
Classes are filled independently: a piece's place is its rank in its class, its
sequence ``base[k] + rank // k``, so no sequence is ever filled by a scan of the
others.  Ranks come from Spark's range sort with carries per partition
(``running_sums``), so a class holding most pieces is spread over many tasks; only
the offsets within one sequence, at most ``capacity`` pieces, are ranked together.

Sequences are padded to ``capacity`` ids by the writer of the training files; the
padding of a sequence is ``capacity`` minus the ``used`` ids in it.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siterank.llm.tables import slices
from siterank.operators.skew import running_sums
from siterank.session import materialize

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


#: ASCII white space: the tokenizer's normalizer makes every run of it one space and its
#: pre-tokenizer never keeps a space in a token, so a text's ids are those of its chunks.
SPACE = re.compile(r"[\t\n\x0b\x0c\r ]+")
#: The normalizers and the pre-tokenizer whose words ``WORDS`` finds as well, in lower-cased
#: texts of ``LATIN`` characters: none of them composes with another.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN = re.compile("[\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\t\n\x0b\x0c\r 0-9a-z\xdf-\xf6\xf8-\xff]+")
#: Distinct words a worker remembers; beyond it starts afresh.
REMEMBER = 1_000_000
#: New words that are encoded as one text.
JOINED = 1_000


class Numbers(dict):
    """Numbers of words in the order they came, the last of them in ``new``."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        number = self[word] = len(self)
        return number


class ChunkEncoder:
    """Ids of the tokenizers library for whole texts, each distinct word encoded once.

    A text is taken as its chunks between white space.  Exact for tokenizers whose
    normalizer replaces white space runs and whose pre-tokenizer drops white space, such
    as word-level BPE with word ends; the tests hold it against the library on whole
    texts.  With the pre-tokenizer ``PATTERN``, chunks of ``LATIN`` characters are taken
    as its words: far fewer are distinct, since case and punctuation no longer tell them
    apart.  Chunks of others, and texts that hold an added token, stay whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [token.content for token in self.library.get_added_tokens_decoder().values()]
        rules = json.loads(self.library.to_str())
        steps = (rules["normalizer"] or {}).get("normalizers", [])
        first = ((rules["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        self.by_words = [x["type"] for x in steps] == NORMALIZERS and first.get("pattern") == {"Regex": PATTERN}
        self.forget()

    def forget(self) -> None:
        self.number = Numbers()
        self.ids, self.bounds = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def words(self, text: str) -> list[str]:
        if not self.by_words or any(token in text for token in self.added):
            return [c for c in SPACE.split(text) if c]
        if LATIN.fullmatch(text):
            return WORDS.findall(text.lower())
        found: list[str] = []
        for chunk in SPACE.split(text):
            if LATIN.fullmatch(chunk):
                found += WORDS.findall(chunk.lower())
            else:
                found.append(chunk)
        return found

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words and how many of them each has.

        Words of ``WORDS`` make one text by the thousand, whose encoding tells them apart.
        """
        plain = [bool(self.by_words and LATIN.fullmatch(w) and WORDS.fullmatch(w)) for w in words]
        whole, alone = [i for i, p in enumerate(plain) if p], [i for i, p in enumerate(plain) if not p]
        joined = [whole[i : i + JOINED] for i in range(0, len(whole), JOINED)]
        coded = self.library.encode_batch([" ".join([words[i] for i in part]) for part in joined], add_special_tokens=False)
        owner, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for part, x in zip(joined, coded):
            of = np.array(x.word_ids, np.int64)
            if len(of) and np.array_equal(np.unique(of), np.arange(len(part))):
                owner.append(np.array(part)[of])
                ids.append(np.array(x.ids, np.int64))
            else:
                alone += part
        for i, x in zip(alone, self.library.encode_batch([words[i] for i in alone], add_special_tokens=False)):
            owner.append(np.full(len(x.ids), i))
            ids.append(np.array(x.ids, np.int64))
        of = np.concatenate(owner)
        return np.concatenate(ids)[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(words))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.number) > REMEMBER:
            self.forget()
        found = [self.words(t) for t in texts]
        n = np.array([len(words) for words in found], np.int64)
        at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(found)), np.int64, int(n.sum()))
        if self.number.new:
            ids, counts = self.encoded(self.number.new)
            self.ids = np.concatenate([self.ids, ids])
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(counts)])
            self.number.new = []
        sizes = np.diff(self.bounds)[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(self.bounds[at] - ends[:-1], sizes) + np.arange(ends[-1])]
        return np.split(ids, ends[np.cumsum(n)][:-1]) if texts else []


@lru_cache(maxsize=2)
def _encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def cut(ids: np.ndarray, capacity: int) -> list[tuple[int, int, int]]:
    """``(start, length, crc32)`` of the pieces of one document's ids."""
    data = ids.astype("<u4")
    return [
        (start, len(piece), zlib.crc32(piece.tobytes()))
        for start in range(0, len(data), capacity)
        for piece in [data[start : start + capacity]]
    ]


def token_pieces(docs: DataFrame, model: str, end_id: int, capacity: int) -> DataFrame:
    """The pieces of every ``(doc_id, text)``: ids by the tokenizers library without
    special tokens of its own, then ``end_id``; a null text counts as empty."""

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(model)
        for frame in slices(frames, "text", 4 << 20):
            texts = frame["text"].where(frame["text"].notna(), "").tolist()
            out = {"doc_id": [], "start": [], "length": [], "ids_crc32": [], "doc_tokens": []}
            for doc_id, coded in zip(frame["doc_id"].tolist(), encode(texts)):
                ids = np.append(coded, end_id)
                for start, length, crc in cut(ids, capacity):
                    out["doc_id"].append(None if doc_id is None or doc_id != doc_id else int(doc_id))
                    out["start"].append(start)
                    out["length"].append(length)
                    out["ids_crc32"].append(crc)
                    out["doc_tokens"].append(len(ids))
            if out["start"]:
                yield pd.DataFrame(out).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(
        pieces, PIECES
    )


def harmonic_pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Place every piece: ``sequence_id`` (from 0, by class) and ``offset`` in it.

    Within a class pieces are taken in order of ``doc_id`` (nulls first), ``start``,
    ``ids_crc32``, ``length``; pieces equal in all four are equal in content, so their
    order among themselves does not change what a sequence holds.  ``used`` is the
    number of ids in the piece's sequence.
    """
    cols = pieces.columns
    classed = pieces.withColumn("_class", F.call_function("div", F.lit(capacity), F.col("length")).cast("long"))
    ranked = running_sums(
        classed.withColumn("_order_id", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))).withColumn(
            "_null_id", F.col("doc_id").isNotNull()
        ),
        ["_class"],
        ["_null_id", "_order_id", "start", "ids_crc32", "length"],
        {"_rank": F.lit(1).cast("long")},
    ).withColumn("_bin", F.call_function("div", F.col("_rank") - 1, F.col("_class")))
    # One row per class: at most ``capacity`` rows, whatever the number of pieces.
    bins = ranked.groupBy("_class").agg(F.max("_bin").alias("_last"))
    earlier = Window.orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)
    bases = bins.select("_class", F.coalesce(F.sum(F.col("_last") + 1).over(earlier), F.lit(0)).alias("_base"))
    in_sequence = Window.partitionBy("_class", "_bin").orderBy("_rank")
    whole = Window.partitionBy("_class", "_bin")
    return (
        ranked.join(F.broadcast(bases), "_class")
        .select(
            *cols,
            (F.col("_base") + F.col("_bin")).alias("sequence_id"),
            (F.sum("length").over(in_sequence) - F.col("length")).alias("offset"),
            F.sum("length").over(whole).alias("used"),
            F.col("_class").alias("class"),
        )
    )


def pack_documents(docs: DataFrame, model: str, end_id: int = 2, capacity: int = 4096) -> DataFrame:
    """Every document of ``(doc_id, text)`` as pieces placed in sequences of ``capacity`` ids.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, used,
    class``: ``start`` counts the document's ids before the piece, ``ids_crc32`` is the
    unsigned CRC-32 of the piece's ids as little-endian 32-bit integers, ``doc_tokens``
    the document's ids with the end id.  Every id of every document is in exactly one
    piece; an empty or null text is one piece of the end id alone.  Repeated rows are
    packed as separate documents.  Extra input columns are not read.
    """
    # Written once: the range sort of the ranks samples its input before it reads it.
    return harmonic_pack(materialize(token_pieces(docs, model, end_id, capacity)), capacity)
