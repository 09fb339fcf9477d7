"""Every operator on small tables against brute force, with nulls, empty texts, ties and repeated rows."""

import collections
import hashlib
import io
import math
import random
import re
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siterank.llm import binary, bytebpe, mixing, neighbours, pieces, quality, setjoin, sharding, suffixes, toxicity, warc
from siterank.llm.catalog import tokenizer_file

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id int, score string, size string"
rng = random.Random(4)
VOCABULARY = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n)) + "."


def edited(text, k, seed):
    r, words = random.Random(seed), text.split(" ")
    for _ in range(k):
        words[r.randrange(len(words))] = "edit%d" % r.randrange(1000)
    return " ".join(words)


def sample_texts():
    base = prose(300, 1)
    passage = prose(150, 2)
    texts = [None, None, "", "", " \n", "one two", "one two", "a b c d e", "é ü 中文 🙂\n\nx", "   "]
    texts += [base, base, edited(base, 3, 5), edited(base, 5, 6), edited(base, 40, 7)]
    texts += [prose(80, 100 + i) + " " + passage + " " + prose(60, 200 + i) for i in range(30)]
    texts += [prose(200, 10), prose(200, 11), prose(12000, 12), "z" * 5000, "ab" * 3000, "\n".join(["same line here"] * 40)]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    texts = sample_texts()
    rows = [(i, t, "en", ["a", "b", None, "Z"][i % 4], None, 7, "x", "y") for i, t in enumerate(texts)]
    rows += [rows[10], rows[12], (None, "lost id", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


# --- quality -------------------------------------------------------------------


def brute_quality(text):
    words = WORDS.findall(text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    counts = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if counts[tuple(words[i : i + 3])] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), failed


def test_quality_counts(docs, empty):
    model = quality.LineModel()
    out = quality.quality_rules(docs, model)
    assert set(docs.columns) < set(out.columns)
    got = sorted((r.text or "", r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out.collect())
    assert got == sorted((t or "", *brute_quality(t)) for _, t in pairs_of(docs))
    assert quality.quality_rules(empty, model).count() == 0


def test_viterbi_is_the_best_sequence():
    model = quality.LineModel([[0.3] * 14, [-0.2] * 14], [[0.5, -1.0], [0.2, 0.1]])
    for seed in range(30):
        r = random.Random(seed)
        masks = [r.randrange(1 << 14) for _ in range(7)]

        def value(labels):
            total = sum(model.lead(m) for m, y in zip(masks, labels) if y)
            return total + sum(model.pair[a][b] for a, b in zip(labels, labels[1:]))

        best = max(value([k >> i & 1 for i in range(7)]) for k in range(128))
        assert math.isclose(value([int(y) for y in model.decode(masks, {})]), best)


def test_line_model_learns(spark, empty):
    junk = "\n".join("ab | cd | ef | gh | ij | kl | mn |" for _ in range(3)) + "\n" + " | ".join(VOCABULARY[:200])
    rows = [(i, prose(120, i) if i % 3 else junk + prose(10, i)) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)] + [(None, 1, 0), (70, None, 0)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in quality.quality_rules(docs, quality.fit_line_model(docs, labels)).collect()}
    assert all(kept[i] == (i % 3 > 0) for i in range(60, 90))
    assert quality.fit_line_model(empty, labels) == quality.LineModel()


# --- toxicity -------------------------------------------------------------------


def test_toxicity_generalises_to_inflections(spark, docs, empty):
    bad = ["grumblo", "snarkwit", "blegfool"]

    def text(i):
        words = prose(100, i).split(" ")
        if i % 4 == 0:
            for k in range(4):
                words[11 * k + 3] = bad[(i + k) % 3] + "abcdefgh"[(i // 4 + k) % 8]
        return " ".join(words)

    given = spark.createDataFrame([(i, text(i)) for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(given, labels)
    rows = toxicity.score_toxicity(given.withColumn("held", toxicity.fold() == 0), model).collect()
    held = [r for r in rows if r.held]
    assert {r.doc_id for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in held]) > 0.97
    scored = toxicity.score_toxicity(docs, model)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in scored.collect())
    assert scored.count() == docs.count() and toxicity.score_toxicity(empty, model).count() == 0
    none = toxicity.fit_toxicity(given, labels.filter("toxic = 0"))
    assert {r.predicted for r in toxicity.score_toxicity(docs, none).collect()} == {0}


def test_letter_model_sums_to_one():
    words = ["banana", "band", "ban", "can", "cab"] * 3 + ["abc"]
    grams = collections.Counter()
    for word in words:
        marked = toxicity.START + word
        for end in range(2, len(marked) + 1):
            grams[marked[max(0, end - 3) : end]] += 1
    model = toxicity.build(list(grams), list(grams.values()), [1] * len(grams), 3, 0.01)
    letters = [chr(c) for c in range(97, 123)]
    # Of a seen history the seen followers and the backed-off rest make up one.
    views = toxicity.Letters(["ba" + c for c in letters])
    hashes = [views.last(k) for k in range(4)]
    lower = np.full(len(views.codes), 1 / 4096)
    for k, level in enumerate(model.shared, 1):
        lower = level.apply(hashes[k], toxicity.before(hashes[k - 1]), lower)
    shares = model.classes[0].apply(hashes[3], toxicity.before(hashes[2]), lower)[views.place == 3]
    assert 0.97 < shares.sum() <= 1.0


# --- sharding --------------------------------------------------------------------


def check_shards(rows, shards=8):
    sizes = collections.Counter(r.shard for r in rows)
    counts = [sizes[s] for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))


def test_shards(spark, docs, empty):
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == docs.count()
    check_shards(rows)
    texts = collections.Counter((r.doc_id, zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 1) for r in docs.collect())
    assert texts == collections.Counter((r.doc_id, r.text_crc32, r.size) for r in rows)
    assert sharding.shard_documents(empty).count() == 0


def test_a_group_larger_than_a_shard_fills_whole_shards(spark):
    rows = [(i, "hot") for i in range(120)] + [(200 + i, f"pair {i // 2}") for i in range(80)] + [(400 + i, f"t{i}") for i in range(160)]
    found = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check_shards(found)
    where = {r.doc_id: r.shard for r in found}
    hot = collections.Counter(where[i] for i in range(120))
    assert len(hot) <= 4 and all(where[200 + 2 * i] == where[201 + 2 * i] for i in range(40))


def test_all_rows_linked(spark):
    found = sharding.shard_documents(spark.createDataFrame([(i, "same") for i in range(51)], "doc_id long, text string")).collect()
    check_shards(found)


def test_copies_change_places_between_full_shards(spark):
    for n, odd in ((400, 0), (403, 3)):
        rows = [(i, f"text {i // 2}") for i in range(2 * n)]
        found = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        check_shards(found)
        where = {r.doc_id: r.shard for r in found}
        # Shards of an odd size must share a pair with another.
        assert sum(where[2 * i] != where[2 * i + 1] for i in range(n)) <= 2 * odd


def test_admissions_go_around_and_keep_quotas():
    assert sharding.admissions({(0, 1): 5, (1, 0): 3}, {(0, 1): (4, 4)}, [0, 0]) == ({(0, 1): 5, (1, 0): 3}, {(1, 0): 3, (0, 1): 1})
    assert sharding.admissions({(0, 1): 2, (1, 2): 2, (2, 0): 1}, {}, [0, 0, 0])[0] == {(0, 1): 1, (1, 2): 1, (2, 0): 1}
    assert sharding.admissions({(0, 1): 2, (1, 2): 2}, {}, [0, 0, 1])[0] == {(0, 1): 1, (1, 2): 1}
    r = random.Random(8)
    for _ in range(200):
        asked = {(s, t): r.randrange(9) for s in range(5) for t in range(5) if s != t and r.random() < 0.5}
        tied = {(s, t): (n, r.randint(1, n)) for s in range(5) for t in range(s + 1, 5) if (n := r.randrange(6))}
        free = [r.choice([0, 0, 3]) for _ in range(5)]
        ask, tie = sharding.admissions(asked, tied, free)
        assert all(0 <= n <= asked[k] for k, n in ask.items())
        assert all(tie.get((s, t), 0) + tie.get((t, s), 0) <= n for (s, t), (n, _) in tied.items())
        for s in range(5):
            moves = [((a, b), n) for d in (ask, tie) for (a, b), n in d.items()]
            assert sum(n for (_, b), n in moves if b == s) - sum(n for (a, _), n in moves if a == s) <= free[s]


# --- neighbours --------------------------------------------------------------------


def test_neighbours(spark):
    r = np.random.default_rng(1)
    centres = r.standard_normal((20, 16))
    vectors = [(i, (centres[i % 20] + 0.2 * r.standard_normal(16)).tolist()) for i in range(1500)]
    vectors += [(2000 + i, vectors[100][1]) for i in range(40)] + [vectors[5], vectors[100]]
    bad = [(3000, None), (3100, [0.0] * 16), (3200, [float("nan")] * 16), (3300, [None] * 16), (None, vectors[0][1]), (3400, [float("inf")] * 16)]
    df = spark.createDataFrame(vectors + bad, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    settings = neighbours.ForestSettings(block=400, query_block=10, share=0.3)
    for x in neighbours.search(df, 100, settings).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.rank, x.vec_id, x.score))
    known = dict(vectors)
    ids = np.array(sorted(known))
    matrix = np.array([known[i] for i in ids])
    hits = 0
    queries = [i for i in ids.tolist() if i % 100 == 0]
    assert set(got) == set(queries)
    for q in queries:
        d = np.sqrt(((matrix - np.array(known[q])) ** 2).sum(1))
        d[ids == q] = np.inf
        want = ids[np.lexsort((ids, d))[:10]].tolist()
        assert [x[0] for x in got[q]] == list(range(1, 11))
        assert [(x[2], x[1]) for x in got[q]] == sorted((x[2], x[1]) for x in got[q])
        hits += len({x[1] for x in got[q]} & set(want))
    assert hits >= 0.9 * 10 * len(queries)
    assert [x[1] for x in got[100]] == [2000 + i for i in range(10)]
    assert neighbours.search(df.limit(0)).count() == 0
    two = neighbours.search(df.filter("vec_id in (0, 1)")).collect()
    assert [(x.query_id, x.rank, x.vec_id) for x in two] == [(0, 1, 1)]


# --- suffixes -----------------------------------------------------------------------


def test_suffix_arrays():
    r = random.Random(1)
    for _ in range(120):
        texts = [[r.randint(1, k) for _ in range(r.randint(0, 40))] + [0] for k in r.choices([1, 2, 3, 20], k=4)]
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        arrays = suffixes.SuffixArrays(np.array(sum(texts, [])), bounds)
        shared = arrays.shared(1000)
        for text, at in zip(texts, bounds):
            want = sorted(range(len(text)), key=lambda i: text[i:])
            assert (arrays.order[at : at + len(text)] - at).tolist() == want
            for x, y in zip(want, want[1:]):
                same = next(k for k in range(99) if max(x, y) + k >= len(text) or text[x + k] != text[y + k])
                assert shared[at + y] == same


def brute_repeats(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        yield len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()


def test_repeated_strings(docs, empty):
    out = suffixes.deduplicate(docs, with_text=True)
    assert set(docs.columns) < set(out.columns)
    got = sorted((r.text or "", r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect())
    texts = [t or "" for _, t in pairs_of(docs)]
    want = [(t, *x) for t, x in zip(texts, brute_repeats([t.encode() for t in texts], 400))]
    assert got == sorted(want) and sum(x[2] for x in want) > 10_000
    assert suffixes.deduplicate(empty).count() == 0


# --- mixing --------------------------------------------------------------------------


def brute_targets(sizes, mix):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weights = {s: mix.weights[i % len(mix.weights)] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    left = mix.share * sum(sizes.values())
    while open_:
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > mix.most * sizes[s]}
        if not over:
            return target | {s: level * weights[s] for s in open_}
        for s in over:
            target[s] = mix.most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mix(docs, empty):
    mix = mixing.Mix(block_words=150)
    placed = mixing.mix_sources(docs, mix)
    rows = placed.withColumn("taken", mixing.taken_words()).collect()
    assert len(rows) == docs.count()
    sizes, taken = collections.Counter(), collections.Counter()
    for r in rows:
        assert r.size == len(WORDS.findall(r.text or "")) and 0 <= r.taken <= 2 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    targets = brute_targets(sizes, mix)
    for r in rows:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, targets[r.source])
    assert all(abs(taken[s] - targets[s]) <= 0.5 for s in sizes)
    key = lambda rows: sorted(map(repr, ((r.doc_id, r.text, r.placements) for r in rows)))
    assert key(mixing.mix_sources(docs.repartition(2), mix).collect()) == key(rows)
    parts = mixing.mixed_documents(placed, ["doc_id", "text", "source"]).collect()
    assert sum(len(WORDS.findall(r.text)) for r in parts) == sum(taken.values())
    assert {r._place.shard for r in parts} <= set(range(8))
    assert mixing.mix_sources(empty, mix).count() == 0


def test_pipeline_mixes_whole_texts(spark, docs):
    import corpus_pipeline

    given = docs.select("doc_id", "text", "lang", "source", F.lit(0).cast("long").alias("n_chars"))
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    rows = corpus_pipeline.mix(spark, given, "").collect()
    assert rows and all((r.doc_id, r.text) in texts for r in rows)
    taken, longest = collections.Counter(), collections.Counter()
    for r in rows:
        taken[r.source] += len(WORDS.findall(r.text))
    for d in docs.collect():
        longest[d.source] = max(longest[d.source], len(WORDS.findall(d.text or "")))
    for r in corpus_pipeline.mix_differences(spark, given).collect():
        assert r.taken == taken[r.source] and math.isclose(r.difference, r.taken - r.target, abs_tol=1e-6)
        assert abs(r.difference) <= longest[r.source] / 2 + 0.5


def test_splitting_tree_keeps_quotas():
    quotas = np.array([0, 5, 17, 1, 300])
    leaves = mixing.split_quotas(quotas, 8, np.random.default_rng(3))
    assert (leaves.sum(0) == quotas).all() and leaves.sum(1).max() - leaves.sum(1).min() <= 3 and (leaves >= 0).all()


# --- token files --------------------------------------------------------------------


def test_elias_fano_round_trip():
    r = random.Random(2)
    for n in (0, 1, 2, 255, 256, 257, 3000):
        values = sorted(r.choice([r.randrange(1 << 40), r.randrange(50)]) for _ in range(n))
        coded = binary.EliasFano(binary.elias_fano(np.array(values, np.uint64)))
        assert coded.values().tolist() == values
        assert [coded.select(i) for i in range(n)] == values
    dense = np.arange(0, 700_000, 7, dtype=np.uint64)
    assert len(binary.elias_fano(dense)) < len(dense) * 8 / 10


def test_token_files(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    path, model = f"file://{tmp_path}/tokens", tokenizer_file("byte_bpe_50k.json")
    make = lambda: bytebpe.shared(model, 2, 0)
    binary.write_token_files(docs, path, make, 2, file_bytes_goal=5_000)
    rows = binary.with_starts(binary.read_token_files(spark, path)).collect()
    library = Tokenizer.from_file(model)
    want = sorted(
        (d is not None, d or 0, zlib.crc32(np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()))
        for d, t in pairs_of(docs)
    )
    rows.sort(key=lambda r: r.start)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids_crc32) for r in rows) == want
    assert [(r.doc_id is not None, r.doc_id or 0) for r in rows] == [w[:2] for w in want]
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
    binary.write_token_files(empty, path + "0", make, 2)
    assert binary.with_starts(binary.read_token_files(spark, path + "0")).count() == 0


def test_byte_bpe_is_the_library():
    from tokenizers import Tokenizer

    path, r = tokenizer_file("byte_bpe_50k.json"), random.Random(3)
    parts = ["a", "don't", " ", "  ", "\n", " \n", "\t", "é", "ñ.", "1", "²", "<|endoftext|>", " ", "中文", "🙂", "x.y", ",", ".", "\x85", "\x1c", "ab,"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(1500)]
    got = bytebpe.ByteBpe(path)(texts)
    library = Tokenizer.from_file(path)
    assert got == [np.array(library.encode(t, add_special_tokens=False).ids + [0], "<u2").tobytes() for t in texts]


# --- pieces ----------------------------------------------------------------------------


def test_pieces_are_the_library(docs, empty):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(3)
    parts = ["a", "b", "don't", " ", "  ", "\n", "é", "ß,", "▁", "▁▁", "中文", "🙂", "x.y", ",", ".", "<s>", "\x00", "<0x0A>", "²."]
    model = pieces.PieceModel(path)
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(1500)]
    for text, (ids, surface) in zip(texts, model.encode(texts)):
        want = library.encode(text)
        assert ids == ",".join(map(str, want)) and model.decode(surface).decode() == library.decode(want)
    # Without any help of the library, by both kinds of agenda.
    words = {w for t in texts for w in model.words(t)}
    assert pieces.PieceModel(path).learn(words) == 0
    assert model.in_step(["▁" + w for w in sorted(words)]) == [model.word_ids("▁" + w) for w in sorted(words)]
    out = pieces.encode_pieces(docs, path, with_ids=True).collect()
    for row in out:
        want = library.encode(row.text or "")
        assert row.ids == want and row.n_tokens == len(want)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(want).encode()).hexdigest()
    assert len(out) == docs.count() and pieces.encode_pieces(empty, path).count() == 0


# --- Jaccard join -------------------------------------------------------------------------


def brute_classes(pairs):
    by_text = collections.defaultdict(list)
    for d, t in pairs:
        by_text[t].append(d)
    texts = list(by_text)

    def shingle_set(t):
        w = WORDS.findall(t or "")
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [shingle_set(t) for t in texts], list(range(len(texts)))
    links = collections.Counter()
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                a, b = root[i], root[j]
                root = [a if x == b else x for x in root]
    classes = collections.defaultdict(list)
    for i, t in enumerate(texts):
        classes[root[i]] += [d for d in by_text[t] if d is not None]
    return [(d, min(classes[root[i]], default=None), links[i]) for i, t in enumerate(texts) for d in by_text[t]]


@pytest.mark.parametrize("bucket", [96, 4])
def test_jaccard_join(docs, empty, spark, bucket):
    base = prose(120, 50)
    many = [(1000 + i, edited(base, i % 3, i)) for i in range(60)] + [(1100 + i, edited(prose(100, 60 + i // 2), i % 2, i)) for i in range(20)]
    given = docs.select("doc_id", "text").union(spark.createDataFrame(many, "doc_id long, text string"))
    settings = setjoin.JoinSettings(bucket=bucket, block=8 if bucket == 4 else 256, recall=0.99999)
    rows = setjoin.near_duplicates(given, settings).collect()
    assert sorted(map(repr, ((r.doc_id, r.class_id, r.n_links) for r in rows))) == sorted(map(repr, brute_classes(pairs_of(given))))
    assert setjoin.near_duplicates(empty, settings).count() == 0


# --- WARC ------------------------------------------------------------------------------------


def test_packages(spark, tmp_path):
    rows = [(3, "u3", "same"), (1, "u1", "same"), (2, None, None), (5, "u5", ""), (None, "n", "same"), (7, "u", "é" * 5000), (1, "u1", "same")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, _page int")
    path = f"file://{tmp_path}/packages"
    warc.write_packages(pages.select("page_id", "url", "html"), path, goal=100)
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in warc.read_packages(spark, path).collect())
    same = 4
    assert got == sorted(
        [(3, same, "revisit", 1), (1, same, "response", 0), (1, same, "revisit", 1), (2, 0, "response", 0), (5, 0, "revisit", 2), (0, same, "revisit", 1), (7, 10000, "response", 0)]
    )
    warc.write_packages(pages.select("page_id", "url", "html"), path + "4", least_bytes=5)
    assert {r.record_type for r in warc.read_packages(spark, path + "4").collect()} == {"response"}
    warc.write_packages(pages.select("page_id", "url", "html").limit(0), path + "0")
    assert warc.read_packages(spark, path + "0").count() == 0


def test_archives_of_others():
    made = [warc.record(i, f"http://x/{i}", b"p%d" % i, "ABC", None, "2020-01-01T00:00:00Z") for i in range(4)]
    data, index, at = b"".join(made), "", 0
    for i, m in enumerate(made):
        index += f"{i}\t{at}\t{len(m)}\n"
        at += len(m)
    own = warc.package([(warc.DATA, data), (warc.INDEX, index.encode())])
    with zipfile.ZipFile(io.BytesIO(own)) as z:
        assert z.testzip() is None and z.read(warc.DATA) == data and z.comment == b"\n"
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w", zipfile.ZIP_STORED) as z:
        z.writestr("packed.txt", b"x" * 100, zipfile.ZIP_DEFLATED)
        with z.open(warc.DATA, "w", force_zip64=True) as f:
            f.write(data)
        z.writestr(warc.INDEX, index)
        z.comment = b"PK\x05\x06 is no end"
    for source in (io.BytesIO(own), other):
        archive = warc.Package(source)
        assert [r.payload for r in archive.records()] == [b"p0", b"p1", b"p2", b"p3"]
        assert [r.payload for r in archive.records(archive.index()[2:3])] == [b"p2"]
    with pytest.raises(ValueError):
        warc.Package(other).stored("packed.txt")
    with pytest.raises(ValueError):
        warc.Package(io.BytesIO(b"no archive"))
