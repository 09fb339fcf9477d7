"""Words of the packing encoder against the tokenizers library on whole texts."""

import random

from siterank.llm.catalog import tokenizer_file
from siterank.llm.packing import ChunkEncoder

MODEL = tokenizer_file("word_bpe_49k.json")


def test_words_are_told_apart_neither_by_case_nor_by_punctuation():
    encoder = ChunkEncoder(MODEL)
    text = "Word, word. WORD (word) Élan élan; word's"
    assert encoder([text])[0].tolist() == encoder.library.encode(text, add_special_tokens=False).ids
    assert set(encoder.number) == {"word", ",", ".", "(", ")", "élan", ";", "'s"}


def test_ids_of_whole_texts():
    """Controls, contractions, marks that compose, added tokens, other scripts."""
    rnd = random.Random(1)
    letters = "ab'sStTdDlLrReEvVmM 09\n\t\x0b\x1c\x85 é́Σσ.,<|>-_\x00日本²½ßİÀÖ×÷ÿÞµªº’"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    texts += ["", "a<|endoftext|>b x", "<|ENDOFTEXT|>", "<|startoftext|>", "x" * 5000]
    encoder = ChunkEncoder(MODEL)
    got = [ids.tolist() for i in range(0, len(texts), 700) for ids in encoder(texts[i : i + 700])]
    assert got == [x.ids for x in encoder.library.encode_batch(texts, add_special_tokens=False)]
    assert encoder([]) == [] and [x.tolist() for x in encoder([""])] == [[]]
