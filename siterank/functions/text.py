"""Text expressions: everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What ``str.split`` and ``str.strip`` treat as white space: the Unicode property and
# the four separator controls.  Java matches the property much faster than a list.
SPACE_RUN = r"(?U)[\s\x{1c}-\x{1f}]+"
WORD_RUN = r"(?U)[^\s\x{1c}-\x{1f}]+"
EDGE_SPACE = r"(?U)^[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+$"

# Java's \W is ASCII only, so the Unicode classes are spelled out.
NON_WORD = r"[^\p{L}\p{N}_]+"
NON_ALNUM = r"[^\p{L}\p{N}]+"
ALNUM_RUN = r"[\p{L}\p{N}]+"

MAX_TOKEN_BYTES = 40


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Strip all Unicode white space (``trim`` removes blanks only)."""
    return F.regexp_replace(col(c), EDGE_SPACE, "")


def clean_text(c: Column | str) -> Column:
    """Stripped text, null as the empty string."""
    return strip(F.coalesce(col(c), F.lit("")))


def collapse_spaces(c: Column | str) -> Column:
    return strip(F.regexp_replace(col(c), SPACE_RUN, " "))


def words(c: Column | str) -> Column:
    """White-space separated words, no empty ones."""
    return F.regexp_extract_all(col(c), F.lit(WORD_RUN), F.lit(0))


def word_count(c: Column | str) -> Column:
    return F.coalesce(F.regexp_count(col(c), F.lit(WORD_RUN)), F.lit(0))


def join_code(c: Column | str) -> Column:
    """Code snippets, each stripped, one per line; a missing list is empty."""
    return F.coalesce(F.array_join(F.transform(col(c), strip), "\n"), F.lit(""))


def keyword_count_in_title(c: Column | str, keywords: list[str]) -> Column:
    """Number of distinct keywords among the lower-cased words of a title."""
    keyword_array = F.array(*[F.lit(k) for k in keywords])
    found = F.array_intersect(words(F.lower(clean_text(c))), keyword_array)
    return F.size(found)


def tokens_default(c: Column | str) -> Column:
    """Lower-cased alphanumeric tokens shorter than 40 bytes."""
    return F.filter(alnum_tokens(c), lambda t: F.octet_length(t) < MAX_TOKEN_BYTES)


def alnum_tokens(c: Column | str) -> Column:
    """Lower-cased alphanumeric tokens of any length; the index is the position."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(ALNUM_RUN), F.lit(0))
