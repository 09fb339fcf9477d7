"""URL expressions: everything here stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from siterank.functions.text import NON_WORD, col, strip

# Generic URI pattern of RFC 3986, appendix B:
# 1 scheme, 2 authority with slashes, 3 authority, 4 path, 5 query with "?", 6 query, 7 fragment.
URL_PATTERN = (
    r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(?:#(.*))?$"
)
SCHEME_PREFIX = r"^[A-Za-z][A-Za-z0-9+.\-]*:"

# Characters a canonical path keeps, with the escapes that stand for them.
PATH_SAFE = {
    "%3A": ":",
    "%2F": "/",
    "%3F": "?",
    "%5B": "[",
    "%5D": "]",
    "%40": "@",
    "%21": "!",
    "%24": "$",
    "%26": "&",
    "%27": "'",
    "%28": "(",
    "%29": ")",
    "%2B": "+",
    "%2C": ",",
    "%3B": ";",
    "%3D": "=",
    "%7C": "|",
    "%7E": "~",
    "%25": "%",
}
NEEDS_PATH_ESCAPE = r"[^A-Za-z0-9\-._~:/?\[\]@!$&'()*+,;=|]"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _part(c: Column | str, group: int) -> Column:
    return F.regexp_extract(col(c), URL_PATTERN, group)


def scheme(c: Column | str) -> Column:
    return F.lower(_part(c, 1))


def netloc(c: Column | str) -> Column:
    """Authority of a URL, '' if there is none; never raises on odd URLs."""
    return _part(c, 3)


def path(c: Column | str) -> Column:
    """Path without the ``;parameters`` of its last segment."""
    return F.regexp_replace(_part(c, 4), r";[^/]*$", "")


def fragment(c: Column | str) -> Column:
    return _part(c, 7)


def without_fragment(c: Column | str) -> Column:
    return F.substring_index(col(c), "#", 1)


def underscore_domain(c: Column | str) -> Column:
    """File-name form of a domain: ``www.A.com`` -> ``a_com``."""
    return F.replace(
        F.replace(strip(F.lower(col(c))), F.lit("www."), F.lit("")), F.lit("."), F.lit("_")
    )


def drop_www(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"^www\.", "")


def in_domain(host: Column | str, domain: Column | str) -> Column:
    """Host is the domain itself or one of its subdomains."""
    host, domain = F.lower(col(host)), F.lower(col(domain))
    return (host == domain) | F.endswith(host, F.concat(F.lit("."), domain))


def keyword_count_in_url(c: Column | str, keywords: list[str]) -> Column:
    """Host labels, path words and fragment words that are keywords, with repeats."""
    parts = F.concat(
        F.split(netloc(c), r"\."), F.split(path(c), NON_WORD), F.split(fragment(c), NON_WORD)
    )
    return F.coalesce(F.size(F.filter(parts, lambda p: p.isin(keywords))), F.lit(0))


def _decode(c: Column) -> Column:
    """Percent-decoding that leaves text with broken escapes as it is."""
    return F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))


def _encode_form(c: Column) -> Column:
    """Form encoding with ``~`` kept and ``*`` escaped."""
    return F.replace(
        F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")
    )


def _canonical_query(query: Column) -> Column:
    def split_pair(arg: Column) -> Column:
        return F.struct(
            _decode(F.substring_index(arg, "=", 1)).alias("k"),
            F.when(F.contains(arg, F.lit("=")), _decode(F.regexp_replace(arg, r"(?s)^[^=]*=", "")))
            .otherwise("")
            .alias("v"),
        )

    args = F.filter(F.split(query, "&"), lambda a: a != "")
    pairs = F.array_sort(F.transform(args, split_pair))
    return F.array_join(
        F.transform(pairs, lambda p: F.concat(_encode_form(p["k"]), F.lit("="), _encode_form(p["v"]))),
        "&",
    )


def _canonical_path(p: Column) -> Column:
    kept = F.regexp_replace(p, "%2[fF]", "%252F")
    kept = F.regexp_replace(kept, "%3[fF]", "%253F")
    decoded = F.coalesce(F.try_url_decode(F.replace(kept, F.lit("+"), F.lit("%2B"))), p)
    encoded = F.replace(F.url_encode(decoded), F.lit("+"), F.lit("%20"))
    for escape, char in PATH_SAFE.items():
        encoded = F.replace(encoded, F.lit(escape), F.lit(char))
    escaped = F.when(p.rlike(NEEDS_PATH_ESCAPE), encoded).otherwise(p)
    return F.regexp_replace(escaped, "^$", "/")


def canonical_url(c: Column | str) -> Column:
    """Lower-case scheme and host, normalised escapes, sorted arguments, no fragment."""

    def build(u: Column) -> Column:
        return F.concat(
            F.regexp_replace(scheme(u), "^(.+)$", "$1:"),
            F.regexp_replace(F.lower(_part(u, 2)), ":+$", ""),
            _canonical_path(_part(u, 4)),
            F.regexp_replace(_canonical_query(_part(u, 6)), r"(?s)^(.+)$", "?$1"),
        )

    return bind(strip(c), build)


def _remove_dot_segments(p: Column) -> Column:
    def step(acc: Column, segment: Column) -> Column:
        return (
            F.when(segment == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1))))
            .when(segment == ".", acc)
            .otherwise(F.concat(acc, F.array(segment)))
        )

    # A closing "." or ".." names a folder.
    folded = F.aggregate(
        F.split(F.regexp_replace(p, r"/(\.\.?)$", "/$1/"), "/"),
        F.array().cast("array<string>"),
        step,
    )
    return F.when(p.rlike(r"(^|/)\.\.?(/|$)"), F.array_join(folded, "/")).otherwise(p)


def url_base(c: Column | str) -> Column:
    """The parts of a page URL that its relative links need."""
    c = col(c)
    folder = F.regexp_extract(_part(c, 4), r"(?s)^(.*/)[^/]*$", 1)
    return F.struct(
        scheme(c).alias("scheme"),
        F.concat(scheme(c), F.lit("://"), netloc(c)).alias("origin"),
        F.regexp_replace(folder, "^$", "/").alias("folder"),
        F.regexp_extract(c, r"(?s)^([^?#]*)", 1).alias("without_query"),
        without_fragment(c).alias("without_fragment"),
    )


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of a link, ``base`` being the ``url_base`` of its page."""

    def build(h: Column) -> Column:
        link_path = F.regexp_extract(h, r"(?s)^([^?#]*)", 1)
        tail = F.regexp_extract(h, r"(?s)([?#].*)$", 1)
        return (
            F.when(h.rlike(SCHEME_PREFIX), h)
            .when(F.startswith(h, F.lit("//")), F.concat(base["scheme"], F.lit(":"), h))
            .when(
                F.startswith(h, F.lit("/")),
                F.concat(base["origin"], _remove_dot_segments(link_path), tail),
            )
            .when(F.startswith(h, F.lit("?")), F.concat(base["without_query"], h))
            .when(
                (h == "") | F.startswith(h, F.lit("#")), F.concat(base["without_fragment"], h)
            )
            .otherwise(
                F.concat(
                    base["origin"],
                    _remove_dot_segments(F.concat(base["folder"], link_path)),
                    tail,
                )
            )
        )

    return bind(strip(href), build)


def resolve_url(base: Column | str, href: Column | str) -> Column:
    """Absolute form of a link found on the page ``base``."""
    return bind(url_base(base), lambda b: resolve(b, col(href)))
