"""Raw pages into crawl records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siterank.functions import text, urls
from siterank.functions.html import parse_pages

# File types a link extractor does not follow by default.
IGNORED_EXTENSIONS = (
    "7z 7zip bz2 rar tar tar.gz xz zip mng pct bmp gif jpg jpeg png pst psp tif tiff ai drw "
    "dxf eps ps svg cdr ico webp mp3 wma ogg wav ra aac mid au aiff 3gp asf asx avi mov mp4 "
    "mpg qt rm swf wmv m4a m4v flv webm xls xlsx xlsm xltx xltm potm potx ppt pptm pptx pps "
    "doc docb docx docm dotm dotx odt ods odg odp css pdf exe bin rss dmg iso apk jar sh rb js "
    "hta bat cpl msi msp py"
).split()


def filter_content_type(df: DataFrame, content_type: str = "content_type") -> DataFrame:
    """Keep HTML and plain text."""
    c = F.col(content_type)
    return df.filter(c.startswith("text/html") | c.startswith("text/plain"))


def extract_title(html: Column | str) -> Column:
    """First text of the first ``<title>``, null if there is none (entities stay)."""
    found = F.regexp_extract_all(text.col(html), F.lit("(?is)<title[^>]*>([^<]*)<"), F.lit(1))
    return text.strip(F.get(found, F.lit(0)))


def extract_tag_texts(html: Column | str, tag: str = "code") -> Column:
    """First text of every element of a kind, stripped, no empty ones (entities stay)."""
    found = F.regexp_extract_all(
        text.col(html), F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>([^<]*)"), F.lit(1)
    )
    return F.filter(F.transform(found, text.strip), lambda t: t != "")


def header_date(header: Column | str) -> Column:
    """Epoch seconds of an HTTP date, null if it is none."""
    day_removed = F.regexp_replace(text.strip(header), "^[A-Za-z]+, *", "")
    return F.unix_timestamp(F.try_to_timestamp(day_removed, F.lit("d MMM yyyy HH:mm:ss z")))


def page_date(last_modified: Column | str, date: Column | str) -> Column:
    """``Last-Modified``, or ``Date`` where that is missing or empty."""
    last_modified = text.col(last_modified)
    given = F.when(last_modified != "", last_modified)
    return header_date(F.coalesce(given, text.col(date)))


def link_text(label: Column, fragment: Column) -> Column:
    """Anchor text on one line, followed by the fragment of the link if there is one."""
    fragment = text.strip(fragment)
    return F.concat(
        text.collapse_spaces(label),
        F.when(fragment != "", F.concat(F.lit(" "), fragment)).otherwise(""),
    )


def html_links(html: Column | str) -> Column:
    """``array<struct<href, text>>`` of the ``<a href>`` elements (entities stay)."""
    anchors = F.regexp_extract_all(
        text.col(html), F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*["'][^"']*["'][^>]*>.*?</a>"""), F.lit(0)
    )
    return F.transform(
        anchors,
        lambda a: F.struct(
            F.regexp_extract(a, r"""(?is)href\s*=\s*["']([^"']*)["']""", 1).alias("href"),
            F.regexp_replace(
                F.regexp_extract(a, r"(?is)^<a[^>]*>(.*)</a>$", 1), "<[^>]*>", ""
            ).alias("text"),
        ),
    )


def resolved_links(
    links: Column,
    base: Column,
    domain: Column,
    ignored_extensions: list[str] = IGNORED_EXTENSIONS,
) -> Column:
    """``array<struct<dst, text, fragment>>`` of the links that stay within a domain."""
    extension = r"(?i)\.(" + "|".join(e.replace(".", r"\.") for e in ignored_extensions) + ")$"

    def absolute(page: Column, link: Column) -> Column:
        return F.struct(
            urls.resolve(page, link["href"]).alias("target"), link["text"].alias("label")
        )

    def canonical(link: Column) -> Column:
        fragment = urls.fragment(link["target"])
        return F.struct(
            urls.canonical_url(link["target"]).alias("dst"),
            link_text(link["label"], fragment).alias("text"),
            fragment.alias("fragment"),
        )

    def wanted(link: Column) -> Column:
        kept = link["dst"].rlike("^(https?|file|ftp)://") & urls.in_domain(
            urls.netloc(link["dst"]), domain
        )
        return kept & ~urls.path(link["dst"]).rlike(extension) if ignored_extensions else kept

    targets = urls.bind(
        urls.url_base(base), lambda page: F.transform(links, lambda link: absolute(page, link))
    )
    return F.filter(F.transform(targets, canonical), wanted)


def extract_links(
    pages: DataFrame,
    key: str = "page_id",
    html: str = "html",
    domain: Column | None = None,
) -> DataFrame:
    """``(key, src, dst, text, fragment)``: one row per link that stays in the domain."""
    domain = urls.netloc("url") if domain is None else domain
    return pages.select(
        key,
        urls.canonical_url("url").alias("src"),
        F.inline(resolved_links(html_links(html), F.col("url"), domain)),
    )


def group_links(links: DataFrame, key: str = "page_id") -> DataFrame:
    """``(key, out_links)``: link texts by target URL.  A group is the links of one page."""
    return (
        links.groupBy(key, "dst")
        .agg(F.array_sort(F.collect_list("text")).alias("texts"))
        .groupBy(key)
        .agg(F.map_from_entries(F.collect_list(F.struct("dst", "texts"))).alias("out_links"))
    )


def with_links_map(df: DataFrame, links: str, name: str) -> DataFrame:
    """Replace the array of links of a page by a map of link texts by target URL.

    Sorting brings the links of a target together within the row, so a page costs
    ``n log n`` in its links and nothing is shuffled.  Texts stay in page order.
    """
    place = F.transform(
        links, lambda link, i: F.struct(link["dst"].alias("dst"), i.alias("i"), link["text"].alias("text"))
    )
    run_start = F.transform(
        "_sorted",
        lambda link, i: F.when((i == 0) | (F.get("_sorted", i - 1)["dst"] != link["dst"]), i),
    )
    run = F.transform(
        "_starts",
        lambda start, j: F.slice(
            "_sorted", start + 1, F.coalesce(F.get("_starts", j + 1), F.size("_sorted")) - start
        ),
    )
    entry = F.transform(
        run, lambda r: F.struct(F.get(r, F.lit(0))["dst"], F.transform(r, lambda link: link["text"]))
    )
    return (
        df.withColumn("_sorted", F.sort_array(place))
        .withColumn("_starts", F.array_compact(run_start))
        .withColumn(name, F.map_from_entries(entry))
        .drop("_sorted", "_starts", links)
    )


def crawl_records(
    pages: DataFrame,
    crawl_domain: Column,
    ord_: Column,
    require_title: bool = True,
    snippet_tag: str = "code",
) -> DataFrame:
    """Crawl records of ``pages(url, html[, content_type, last_modified, date_header])``.

    One parse per page and no shuffle.  Pages without a title give no record.
    """
    columns = set(pages.columns)
    if "content_type" in columns:
        pages = filter_content_type(pages)
    given = pages.select(
        crawl_domain.alias("crawl_domain"),
        ord_.cast("bigint").alias("ord"),
        "url",
        (
            page_date("last_modified", "date_header")
            if {"last_modified", "date_header"} <= columns
            else F.lit(None).cast("bigint")
        ).alias("date"),
        (
            F.col("content_type").startswith("text/plain")
            if "content_type" in columns
            else F.lit(False)
        ).alias("plain"),
        (
            # The html goes to Python once; only plain texts, which are not parsed, go beside it.
            F.when(F.col("content_type").startswith("text/plain"), F.col("html"))
            if "content_type" in columns
            else F.lit(None).cast("string")
        ).alias("plain_text"),
        "html",
    )
    parsed = parse_pages(given, "html", snippet_tag)
    base = F.coalesce(urls.resolve_url("url", F.col("parsed.base_href")), F.col("url"))
    links = resolved_links(F.col("parsed.links"), base, F.col("crawl_domain"))
    records = parsed.select(
        "crawl_domain",
        "ord",
        "date",
        urls.canonical_url("url").alias("url"),
        text.strip("parsed.title").alias("title"),
        F.when(F.col("plain"), text.strip("plain_text"))
        .otherwise(F.col("parsed.content"))
        .alias("content"),
        F.col("parsed.snippets").alias("code_snippets"),
        links.alias("_links"),
    )
    if require_title:
        records = records.filter(F.col("title").isNotNull())
    return with_links_map(records, "_links", "out_links")
