"""Exact ids of the ``tokenizers`` library, with the work done once per distinct word.

A byte-level tokenizer splits a text before every space that is followed by no other
white space, whatever comes before or after.  So a text without a space in front of
white space is encoded chunk by chunk, and a chunk that was seen before costs one look
into a dictionary.  Any other text, and one with the string of a special token, goes
to the library as it is.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

#: Distinct chunks a worker remembers; beyond it starts afresh.
REMEMBER = 1_200_000


class ByteBpe:
    """Encoder to ``width`` little-endian bytes per id, each text followed by ``end``."""

    def __init__(self, path: str, width: int = 2, end: int | None = 0):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.kind = f"<u{width}"
        self.tail = b"" if end is None else np.array([end], self.kind).tobytes()
        special = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join([r" \s", *special]))
        sizes = self.library.get_vocab(with_added_tokens=True)
        self.sizes = np.zeros(max(sizes.values()) + 1, np.int64)
        for token, i in sizes.items():
            self.sizes[i] = len(token)
        #: Ids of a chunk with a space in front, and of one at the start of a text.
        self.chunks: dict[str, bytes] = {}
        self.firsts: dict[str, bytes] = {}
        self.marks = {m: self.library_ids(m) for m in (".", ",")}

    def library_ids(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def learn(self, new: set[str]) -> None:
        """Encode chunks that have a space in front, many at a time in one string.

        The library splits that string before each of these spaces, and a token of the
        vocabulary has one letter per byte, so the ids fall apart at the chunk ends again.
        A word of letters and the mark after it are split by the library in any case.
        """
        marked = [c for c in new if c[-1:] in self.marks and c[:-1].isalpha()]
        wanted = new.difference(marked)
        wanted.update([w for c in marked if (w := c[:-1]) not in self.chunks])
        if "" in wanted:
            # A space at the very end of a text.
            self.chunks[""] = self.library_ids(" ")
        words = [c for c in wanted if c]
        width = int(self.kind[2:])
        lots = [words[i : i + 2000] for i in range(0, len(words), 2000)]
        joined = [" " + " ".join(lot) for lot in lots]
        for lot, found in zip(lots, self.library.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(found.ids, np.int64)
            sizes = np.cumsum([len(c.encode()) + 1 for c in lot])
            ends = (np.searchsorted(np.cumsum(self.sizes[ids]), sizes) + 1) * width
            data, at = ids.astype(self.kind).tobytes(), 0
            for chunk, end in zip(lot, ends.tolist()):
                self.chunks[chunk] = data[at:end]
                at = end
        self.chunks.update([(c, self.chunks[c[:-1]] + self.marks[c[-1]]) for c in marked])

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [None if self.whole.search(t) else t.split(" ") for t in texts]
        firsts = [None if chunks is None else chunks.pop(0) for chunks in split]
        wanted = set().union(*[chunks for chunks in split if chunks])
        new = wanted.difference(self.chunks)
        if len(self.chunks) + len(new) > REMEMBER:
            self.chunks.clear()
            new = wanted
        if len(self.firsts) > REMEMBER // 10:
            self.firsts.clear()
        self.learn(new)
        known, out = self.chunks.__getitem__, []
        for text, first, chunks in zip(texts, firsts, split):
            if chunks is None:
                out.append(self.library_ids(text) + self.tail)
                continue
            head = self.firsts.get(first)
            if head is None:
                head = self.firsts[first] = self.library_ids(first)
            out.append(head + b"".join(map(known, chunks)) + self.tail)
        return out


@lru_cache(maxsize=1)
def shared(path: str, width: int = 2, end: int | None = 0) -> ByteBpe:
    """The encoder of this worker process, with what it remembers from earlier tasks."""
    return ByteBpe(path, width, end)
