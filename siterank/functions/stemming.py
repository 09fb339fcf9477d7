"""English stemming (the public Snowball "Porter2" rules) for token arrays.

Arrow hands a whole batch of token arrays to the function; only the distinct
tokens of the batch are stemmed, so the Python work follows the vocabulary and
not the text, and neither a shuffle nor a broadcast of the vocabulary is needed.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the published algorithm.
WHOLE_WORDS = {
    "skis": "ski",
    "skies": "sky",
    "dying": "die",
    "lying": "lie",
    "tying": "tie",
    "idly": "idl",
    "gently": "gentl",
    "ugly": "ugli",
    "early": "earli",
    "only": "onli",
    "singly": "singl",
    "sky": "sky",
    "news": "news",
    "howe": "howe",
    "atlas": "atlas",
    "cosmos": "cosmos",
    "bias": "bias",
    "andes": "andes",
}
AFTER_STEP_1A = {
    "inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed",
}
STEP_2 = {
    "tional": "tion",
    "enci": "ence",
    "anci": "ance",
    "abli": "able",
    "entli": "ent",
    "izer": "ize",
    "ization": "ize",
    "ational": "ate",
    "ation": "ate",
    "ator": "ate",
    "alism": "al",
    "aliti": "al",
    "alli": "al",
    "fulness": "ful",
    "ousli": "ous",
    "ousness": "ous",
    "iveness": "ive",
    "iviti": "ive",
    "biliti": "ble",
    "bli": "ble",
    "ogi": "og",
    "fulli": "ful",
    "lessli": "less",
    "li": "",
}
STEP_3 = {
    "tional": "tion",
    "ational": "ate",
    "alize": "al",
    "icate": "ic",
    "iciti": "ic",
    "ical": "ic",
    "ful": "",
    "ness": "",
    "ative": "",
}
STEP_4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism",
    "ate", "iti", "ous", "ive", "ize", "ion",
]

VOWEL = "[aeiouy]"
REGION = re.compile(f"{VOWEL}[^aeiouy]")
SHORT_SYLLABLE_END = re.compile(r"([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
HAS_VOWEL = re.compile(VOWEL)


def _suffix(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _regions(word: str) -> tuple[int, int]:
    prefix = re.match("gener|commun|arsen", word)
    first = prefix or REGION.search(word)
    r1 = first.end() if first else len(word)
    second = REGION.search(word, r1)
    return r1, second.end() if second else len(word)


@lru_cache(maxsize=1 << 18)
def stem(word: str) -> str:
    if len(word) < 3:
        return word
    if word in WHOLE_WORDS:
        return WHOLE_WORDS[word]
    # A "y" that acts as a consonant is written "Y" until the end.
    word = re.sub(f"^y|(?<={VOWEL})y", "Y", word)
    r1, r2 = _regions(word)
    word = _plurals(word)
    if word in AFTER_STEP_1A:
        return word
    word = _past_and_gerund(word, r1)
    if len(word) > 2 and word[-1] in "yY" and not HAS_VOWEL.match(word[-2]):
        word = word[:-1] + "i"
    word = _derivations(word, r1, r2)
    return _endings(word, r1, r2).replace("Y", "y")


def _plurals(word: str) -> str:
    suffix = _suffix(word, ["sses", "ied", "ies", "us", "ss", "s"])
    if suffix == "sses":
        return word[:-2]
    if suffix in ("ied", "ies"):
        return word[:-2] if len(word) > 4 else word[:-1]
    if suffix == "s" and HAS_VOWEL.search(word[:-2]):
        return word[:-1]
    return word


def _past_and_gerund(word: str, r1: int) -> str:
    suffix = _suffix(word, ["eed", "eedly", "ed", "edly", "ing", "ingly"])
    if suffix is None:
        return word
    base = word[: -len(suffix)]
    if suffix in ("eed", "eedly"):
        return base + "ee" if len(base) >= r1 else word
    if not HAS_VOWEL.search(base):
        return word
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", base):
        return base[:-1]
    if len(base) <= r1 and SHORT_SYLLABLE_END.search(base):
        return base + "e"
    return base


def _derivations(word: str, r1: int, r2: int) -> str:
    suffix = _suffix(word, STEP_2)
    if suffix and len(word) - len(suffix) >= r1:
        before = word[: -len(suffix)]
        if not (suffix == "ogi" and not before.endswith("l")) and not (
            suffix == "li" and before[-1:] not in tuple("cdeghkmnrt")
        ):
            word = before + STEP_2[suffix]
    suffix = _suffix(word, STEP_3)
    if suffix and len(word) - len(suffix) >= (r2 if suffix == "ative" else r1):
        word = word[: -len(suffix)] + STEP_3[suffix]
    return word


def _endings(word: str, r1: int, r2: int) -> str:
    suffix = _suffix(word, STEP_4)
    if suffix and len(word) - len(suffix) >= r2:
        before = word[: -len(suffix)]
        if suffix != "ion" or before.endswith(("s", "t")):
            word = before
    cut = len(word) - 1
    if word.endswith("e"):
        if cut >= r2 or (cut >= r1 and not SHORT_SYLLABLE_END.search(word[:-1])):
            return word[:-1]
    elif word.endswith("ll") and cut >= r2:
        return word[:-1]
    return word


@F.arrow_udf(T.ArrayType(T.StringType()))
def stem_tokens(tokens: pa.Array) -> pa.Array:
    """Stem every token of every array; nulls stay null."""
    encoded = tokens.values.dictionary_encode()
    stems = pa.array([stem(t) for t in encoded.dictionary.to_pylist()], pa.string())
    mask = tokens.is_null() if tokens.null_count else None
    return pa.ListArray.from_arrays(
        tokens.offsets, pa.DictionaryArray.from_arrays(encoded.indices, stems).cast(pa.string()),
        mask=mask,
    )
