"""Conversation repair, harmonic packing and block search against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from siterank.llm import lexsearch, packing, repair
from siterank.llm.catalog import tokenizer_file


# ---------------------------------------------------------------- conversation repair


def least_edits(initials, must_go, truncated):
    """Cheapest edit string, least in ASCII order among the cheapest, by dynamic programming."""
    n = len(initials)
    best = {}
    for i in range(n, -1, -1):
        here = {s: (math.inf, "") for s in range(4)}
        if i == n:
            for s in repair.ACCEPTING:
                here[s] = (0, "")
        for _ in range(8):  # inserts loop between states of one row; costs are positive
            for s in range(4):
                for letter, cost, ni, ns, _ in repair.edits(initials, must_go, truncated, i, s):
                    rest = here[ns] if ni == i else best[(ni, ns)]
                    cand = (cost + rest[0], letter + rest[1])
                    if cand < here[s] and not (i == n and s in repair.ACCEPTING):
                        here[s] = cand
        for s in range(4):
            best[(i, s)] = here[s]
    return best[(0, repair.START)]


def test_search_equals_dynamic_programming():
    rng = random.Random(3)
    for _ in range(400):
        n = rng.randint(0, 9)
        initials = [rng.choice("suax") for _ in range(n)]
        must_go = [rng.random() < 0.2 for _ in range(n)]
        truncated = [not g and rng.random() < 0.3 for g in must_go]
        cost, path = repair.search(initials, must_go, truncated)
        assert (cost, "".join(letter for letter, _ in path)) == least_edits(initials, must_go, truncated)


def test_search_of_a_long_conversation_is_bounded():
    rng = random.Random(5)
    n = 3000
    initials = [rng.choice("ua") for _ in range(n)]
    must_go = [rng.random() < 0.1 for _ in range(n)]
    truncated = [not g and rng.random() < 0.1 for g in must_go]
    cost, path = repair.search(initials, must_go, truncated)
    assert sum(letter != "I" for letter, _ in path) == n
    assert (cost, "".join(letter for letter, _ in path)) == least_edits(initials, must_go, truncated)


def damage_code(conv_id, turn):
    key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
    return zlib.crc32(key.encode()) % 20


def test_repair_rows(spark):
    dropped = next(t for t in range(1000) if damage_code(7, t) == 0)
    clean = [t for t in range(1000) if damage_code(1, t) >= 5][:4]
    rows = [
        (1, clean[0], "system", "Be brief.", 1, 2, 3),
        (1, clean[1], "user", "Hello there.", 1, 2, 3),
        (1, clean[2], "assistant", "Hi", 1, 2, 3),
        (1, clean[3], "assistant", None, 1, 2, 3),
        (7, dropped, "user", "gone.", 1, 2, 3),
        (None, None, None, None, 1, 2, 3),
        (None, 4, "user", "Q?", 1, 2, 3),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, _gone int, _copy int, _damage int")
    got = {r["conv_id"]: r.asDict() for r in repair.repair_conversations(df).collect()}
    assert set(got) == {1, 7, None}
    assert got[7] | {"conv_id": 7} == {
        "conv_id": 7, "rows": 0, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0,
        "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest(),
    }
    one = got[1]
    # Keeping the truncated "Hi" costs 5 (KKKD, 7); two reroles and its deletion cost 6.
    assert (one["blank"], one["truncated"], one["illegal"], one["cost"], one["audit"]) == (1, 1, 1, 6, "RRDD")
    expected = "\n".join(["user:Be brief.", "assistant:Hello there."])
    assert one["repaired_sha256"] == hashlib.sha256(expected.encode()).hexdigest()
    assert got[None]["rows"] >= 1


# ---------------------------------------------------------------- harmonic packing


def test_packing_covers_every_id(spark):
    long_text = " ".join(f"word{i % 97} and more" for i in range(3000))
    texts = [None, "", "Hello world.", "Hello world.", long_text, "short text here", "é ü 中文 🙂", "<|endoftext|> x"]
    rows = [(i // 2 if i != 5 else None, t, "x", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, _class int")
    model = tokenizer_file("word_bpe_49k.json")
    got = packing.pack_documents(df, model, end_id=2, capacity=64).toPandas()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(model)
    want = Counter()
    for doc_id, text in [(r[0], r[1]) for r in rows]:
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        for start in range(0, len(ids), 64):
            piece = ids[start : start + 64]
            want[(doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids))] += 1
    have = Counter(
        (None if r.doc_id is None or r.doc_id != r.doc_id else int(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens)
        for r in got.astype(object).itertuples(index=False)
    )
    assert have == want
    for seq, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert list(part["offset"]) == list(np.cumsum([0, *part["length"]])[:-1])
        assert part["length"].sum() <= 64 and (part["used"] == part["length"].sum()).all()
        k = int(part["class"].iloc[0])
        assert (part["class"] == k).all() and len(part) <= k
        assert all(64 // length == k for length in part["length"])
    per_class = got.groupby("class")["sequence_id"].nunique()
    counts = got.groupby("class").size()
    assert all(per_class[k] == math.ceil(counts[k] / k) for k in counts.index)


def test_pieces_of_a_document_rebuild_its_ids(spark):
    text = " ".join(f"w{i}" for i in range(500))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    model = tokenizer_file("word_bpe_49k.json")
    got = packing.token_pieces(df, model, 2, 100).orderBy("start").collect()
    from tokenizers import Tokenizer

    ids = np.array(Tokenizer.from_file(model).encode(text, add_special_tokens=False).ids + [2], "<u4")
    assert [r["start"] for r in got] == list(range(0, len(ids), 100))
    assert [r["ids_crc32"] for r in got] == [zlib.crc32(ids[s : s + 100].tobytes()) for s in range(0, len(ids), 100)]


# ---------------------------------------------------------------- block search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(docs, items, k=10):
    def terms(t):
        return TERM.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))

    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    big_n, big_l = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item_id, text in items:
        asked = terms(text)
        scores = []
        for d, c in counted:
            n = sum(c.values())
            m = 25 + (75 * n * big_n) // big_l
            s = 0
            for t in asked:
                if c[t]:
                    w = math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1)))
                    s += w * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
            if s > 0:
                scores.append((-s, -math.inf if d is None else d, d, s))
        for rank, (_, _, d, s) in enumerate(sorted(scores)[:k], 1):
            out.append((item_id, rank, d, s))
    return sorted(out, key=lambda r: (r[0], r[1]))


def test_block_search_equals_brute_force(spark):
    rng = random.Random(8)
    words = ["Alpha", "beta", "gamma", "délta", "x1", "y2", "zz", "qq", "the", "of", "Mid9dle", "中文"]
    docs = [(i, " ".join(rng.choice(words[: rng.randint(3, 12)]) for _ in range(rng.randint(1, 40)))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "!!! ..."), (5, docs[5][1]), (None, "alpha beta"), (7, docs[7][1])]
    items = [(0, "alpha beta gamma"), (1, "THE of the"), (2, "中文 délta zz zz"), (3, "nothing-here"), (4, None), (5, "qq")]
    d = spark.createDataFrame([(a, b, 1, "x") for a, b in docs], "doc_id long, text string, _row int, term string")
    q = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, query int")
    for block_docs, top in ((4, 1), (64, 8)):
        got = [tuple(r) for r in lexsearch.search(d, q, k=10, block_docs=block_docs, top=top, seed_blocks=1).collect()]
        assert sorted(got, key=lambda r: (r[0], r[1])) == brute_search(docs, items)
