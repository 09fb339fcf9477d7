"""SentencePiece encoding and decoding for vocabularies of the merge type.

The pieces of such a vocabulary hold the space mark only at their start or throughout,
so merges never cross from a letter to a mark and a text is encoded one marked word at
a time.  A word is split into its characters; an agenda holds every adjacent pair that
is a piece, best score first and leftmost among equals, and the best pair is merged
until none is left.  New words of a batch work off their agendas in step, as arrays.  Characters without a piece become their UTF-8 bytes.  A word is
worked out once per worker, and what comes out is held against the sentencepiece
library in the same Arrow batch: on a difference the library's ids are taken.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siterank.llm.tables import slices

MARK = "▁"
#: A run of marks and what follows up to the next mark.
MARKED_WORD = re.compile("▁*[^▁]+|▁+")
#: Distinct words a worker remembers; beyond it starts afresh.
REMEMBER = 400_000
#: Longer words keep an agenda of their own.
IN_STEP = 48
NO_RANK = 1 << 30


class PieceModel:
    """Encoder and decoder made from the pieces of a model file."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        normal = model.normalizer_spec
        if (
            model.trainer_spec.model_type != proto.TrainerSpec.BPE
            or normal.precompiled_charsmap
            or normal.remove_extra_whitespaces
            or not (normal.add_dummy_prefix and normal.escape_whitespaces)
            or any(MARK in p.piece.lstrip(MARK) for p in model.pieces)
            or any(p.type == p.USER_DEFINED for p in model.pieces)
        ):
            raise ValueError("needs a merge-type vocabulary with a space mark in front and no normalization")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.merges = {p.piece: (-p.score, i) for i, p in enumerate(model.pieces) if p.type == p.NORMAL}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == p.BYTE}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == p.UNKNOWN)
        self.surface = [
            bytes([int(p.piece[1:-1], 16)])
            if p.type == p.BYTE
            else b""
            if p.type == p.CONTROL
            else model.trainer_spec.unk_surface.encode()
            if p.type == p.UNKNOWN
            else p.piece.replace(MARK, " ").encode()
            for p in model.pieces
        ]
        self._pair_table()
        #: A mark at the end of a word, and the characters some piece has in front of it.
        self.tails = {m: {a for p in self.merges for a, b in zip(p, p[1:]) if b == m} for m in ".,"}
        #: What is known of a word, named without its first mark: its ids as decimals
        #: with commas, and their surface.
        self.ids: dict[str, str] = {}
        self.texts: dict[str, bytes] = {}

    def _pair_table(self) -> None:
        """Every pair of symbols that makes a piece: sorted pair numbers, rank and result."""
        symbols = dict.fromkeys(self.merges)
        symbols.update(dict.fromkeys(c for p in self.merges for c in p))
        number = {s: i for i, s in enumerate(symbols)}
        by_score = sorted(self.merges, key=lambda p: self.merges[p])
        self.n_symbols = len(number) + 1
        found = [
            (number[p[:k]] * self.n_symbols + number[p[k:]], rank, number[p])
            for rank, p in enumerate(by_score)
            for k in range(1, len(p))
            if p[:k] in number and p[k:] in number
        ]
        # Equal scores are one rank: among them the leftmost pair goes first.
        scores = np.array([self.merges[p][0] for p in by_score])
        level = np.cumsum(np.append([0], scores[1:] != scores[:-1]))
        table = np.array(sorted(found), np.int64)
        self.pairs, self.results = table[:, 0].copy(), table[:, 2].copy()
        self.ranks = level[table[:, 1]]
        # The last number stands for every character that is in no piece.
        self.char_symbol = np.full(0x110000, self.n_symbols - 1, np.int32)
        for s, i in number.items():
            if len(s) == 1:
                self.char_symbol[ord(s)] = i
        self.symbol_id = np.array([self.merges[s][1] if s in self.merges else -1 for s in number] + [-1])

    def looked_up(self, owner: np.ndarray, symbol: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of the pairs that begin at these places."""
        after = np.minimum(at + 1, len(symbol) - 1)
        key = symbol[at] * self.n_symbols + symbol[after]
        found = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        ok = (self.pairs[found] == key) & (owner[after] == owner[at]) & (after > at)
        return np.where(ok, self.ranks[found], NO_RANK), self.results[found]

    def in_step(self, words: list[str]) -> list[list[int]]:
        """The ids of many words: in every round each word merges the best pair of its agenda."""
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.array([len(w) for w in words])
        owner = np.repeat(np.arange(len(words)), sizes)
        symbol = self.char_symbol[chars].astype(np.int64)
        done: list[tuple[np.ndarray, ...]] = []
        rank, result = self.looked_up(owner, symbol, np.arange(len(symbol)))
        while len(symbol):
            n = len(symbol)
            first = np.flatnonzero(np.append([True], owner[1:] != owner[:-1]))
            best = np.minimum.reduceat((rank << 32) | np.arange(n), first)
            open_words = best < NO_RANK << 32
            merged = best[open_words] & 0xFFFFFFFF
            symbol[merged] = result[merged]
            keep = np.ones(n, bool)
            keep[merged + 1] = False
            going = np.repeat(open_words, np.diff(np.append(first, n)))
            ended = ~going
            done.append((owner[ended], symbol[ended], chars[ended]))
            keep &= going
            moved_to = np.cumsum(keep) - 1
            owner, symbol, chars, rank, result = (x[keep] for x in (owner, symbol, chars, rank, result))
            # Only the pairs on both sides of a merged one are new to the agendas.
            at = moved_to[merged]
            at = np.concatenate([at, at[at > 0] - 1])
            rank[at], result[at] = self.looked_up(owner, symbol, at)
        owner, symbol, chars = (np.concatenate(x) for x in zip(*done))
        by = np.argsort(owner, kind="stable")
        owner, ids, chars = owner[by], self.symbol_id[symbol[by]], chars[by]
        bounds = np.searchsorted(owner, np.arange(len(words) + 1))
        out, ids = [], ids.tolist()
        plain = np.ones(len(words), bool)
        plain[owner[self.symbol_id[symbol[by]] < 0]] = False
        for word, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            found = ids[a:b]
            if not plain[word]:
                found = [x for i, c in zip(found, chars[a:b].tolist()) for x in ([i] if i >= 0 else self.spelled(chr(c)))]
            out.append(found)
        return out

    def spelled(self, char: str) -> list[int]:
        """A character that is no piece: its bytes, or the unknown piece."""
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown]

    def word_ids(self, word: str) -> list[int]:
        """The ids of one marked word, by its agenda of adjacent pairs."""
        merges = self.merges
        symbols: list[str | None] = list(word)
        n = len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            pair = word[i : i + 2]
            if pair in merges:
                agenda.append((merges[pair][0], i, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            j = right[i]
            # An entry is out of date when one of its two symbols has been merged since.
            if symbols[i] is None or j >= n or symbols[i] + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, None
            right[i] = after = right[j]
            if after < n:
                left[after] = i
                wider = pair + symbols[after]
                if wider in merges:
                    heapq.heappush(agenda, (merges[wider][0], i, wider))
            before = left[i]
            if before >= 0:
                wider = symbols[before] + pair
                if wider in merges:
                    heapq.heappush(agenda, (merges[wider][0], before, wider))
        ids: list[int] = []
        for symbol in symbols:
            if symbol is None:
                continue
            if symbol in merges:
                ids.append(merges[symbol][1])
            else:
                ids += self.spelled(symbol)
        return ids

    def learn(self, new: set[str]) -> int:
        """Work out new words and check them; returns how many differed from the library.

        Words are named without their first mark: the library puts it in front itself.
        A full stop or comma at the end, behind a character no piece has in front of it,
        never merges: such a word is the word without it and then the mark.
        """
        tailed = [w for w in new if len(w) > 1 and w[-1] in self.tails and w[-2] not in self.tails[w[-1]]]
        words = list(new.difference(tailed).union([w[:-1] for w in tailed]).difference(self.ids, tailed))
        short = [w for w in words if len(w) < IN_STEP]
        made = dict(zip(short, self.in_step([MARK + w for w in short])) if short else ())
        wrong = 0
        for word, given in zip(words, self.library.encode(words, num_threads=1)):
            ids = made[word] if word in made else self.word_ids(MARK + word)
            # A mark alone is nothing to the library.
            if ids != given and word:
                ids, wrong = given, wrong + 1
            self.ids[word] = ",".join(map(str, ids))
            self.texts[word] = b"".join([self.surface[i] for i in ids])
        for word in sorted(tailed, key=len):
            last = self.merges[word[-1]][1] if word[-1] in self.merges else self.spelled(word[-1])[0]
            self.ids[word] = f"{self.ids[word[:-1]]},{last}"
            self.texts[word] = self.texts[word[:-1]] + word[-1].encode()
        return wrong

    @staticmethod
    def words(text: str) -> list[str]:
        """The marked words of a text, without their first mark."""
        if not text:
            return []
        if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
            return [w[1:] for w in MARKED_WORD.findall(MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """Ids of every text as decimals with commas, and their surface."""
        split = [self.words(t) for t in texts]
        wanted = set().union(*split)
        new = wanted.difference(self.ids)
        if len(self.ids) + len(new) > REMEMBER:
            self.ids.clear()
            self.texts.clear()
            new = wanted
        self.learn(new)
        ids, surface = self.ids.__getitem__, self.texts.__getitem__
        return [(",".join(map(ids, words)), b"".join(map(surface, words))) for words in split]

    @staticmethod
    def decode(surface: bytes) -> bytes:
        """The text in UTF-8: the surfaces of the pieces without the first space."""
        return surface.removeprefix(b" ").decode("utf-8", "replace").encode()


@lru_cache(maxsize=1)
def shared(path: str) -> PieceModel:
    """The model of this worker process, with the words it remembers from earlier tasks."""
    return PieceModel(path)


def encode_pieces(docs: DataFrame, model_path: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """Add ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` (and ``ids``) to documents.

    Whole texts, no begin or end ids.  A null text counts as empty and has no ids; the
    digest of no ids is that of the empty string.  Columns of these names are replaced,
    all others stay, rows repeat as they came.  One pass, no shuffle; a worker holds a
    slice of texts and a bounded memory of words.
    """
    extra = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    docs = docs.drop(*[c for c in extra if c in docs.columns])
    # Texts of a record are looked at alone; every other column goes through untouched.
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema])
    schema += ", n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared(model_path)
        for frame in slices(frames, text, 1 << 20):
            coded = model.encode([t or "" for t in frame[text].tolist()])
            frame = frame.assign(
                n_tokens=[ids.count(",") + 1 if ids else 0 for ids, _ in coded],
                ids_sha256=[hashlib.sha256(ids.encode()).hexdigest() for ids, _ in coded],
                decoded_sha256=[hashlib.sha256(model.decode(surface)).hexdigest() for _, surface in coded],
            )
            if with_ids:
                frame["ids"] = [np.array(ids.split(","), np.int32) if ids else np.zeros(0, np.int32) for ids, _ in coded]
            yield frame

    return docs.mapInPandas(run, schema)
