"""The join of near copies: buckets too large for one task."""

import random

import pytest
from pyspark.sql import functions as F

from siterank.llm import setjoin


def near_copies(n: int, seed: int) -> list[tuple[int, str]]:
    """Texts that differ from one in one to five places, most of them linked with some of the others only."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(900)}" for _ in range(110)]
    out = []
    for i in range(n):
        words = list(base)
        for _ in range(1 + i % 5):
            words[rng.randrange(len(words))] = f"x{rng.randrange(40)}"
        out.append((i, " ".join(words)))
    return out


def expected(rows: list[tuple[int, str]], words: int) -> list[tuple[int, int, int]]:
    sets = {}
    for _, text in rows:
        w = text.split()
        sets[text] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}
    linked = {a: {b for b in sets if a != b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])} for a in sets}
    ids = {}
    for i, text in rows:
        ids.setdefault(text, []).append(i)
    found = {}
    for text in sets:
        seen, todo = {text}, [text]
        while todo:
            new = linked[todo.pop()] - seen
            seen |= new
            todo += new
        found[text] = min(min(ids[t]) for t in seen), len(linked[text])
    return sorted((i, *found[text]) for i, text in rows)


@pytest.mark.parametrize("block_bytes", [4 << 20, 4000])
def test_many_near_copies_are_counted_in_blocks(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(setjoin, "TILES", 3)
    monkeypatch.setattr(setjoin, "BLOCK_BYTES", block_bytes)
    rows = near_copies(300, 5)
    settings = setjoin.JoinSettings(bucket=20, block=24, recall=0.999999)
    got = setjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), settings).collect()
    want = expected(rows, settings.words)
    assert 0 < sum(x[2] for x in want) < 300 * 299
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == want


def test_copies_of_blocks_grow_as_the_blocks(spark):
    def copies(blocks: int) -> int:
        packed = spark.range(blocks).select(F.lit(1).alias("_node"), F.lit(blocks).alias("_blocks"), F.col("id").alias("_block"))
        return setjoin.tiled(packed).count()

    assert copies(4) == 16
    assert copies(800) == 4 * copies(200) == 800 * setjoin.TILES
