"""One HTML parse per page, in Arrow batches.

The parser is a small helper: it yields the title, the snippets, the links and
the main text of one page.  Everything after it is DataFrame work.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

VOID_TAGS = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
    "track", "wbr",
}
# An opening tag of these closes an open one of the same kind ...
SELF_CLOSING = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
# ... unless one of these stands between them.
CONTAINERS = {"ul", "ol", "dl", "table", "div", "article", "main", "section", "body", "select"}
BLOCKS = SELF_CLOSING | CONTAINERS | {
    "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "br", "hr",
}
BOILERPLATE = {
    "nav", "header", "footer", "aside", "script", "style", "noscript", "template", "button",
    "head", "title",
}
MAIN_REGIONS = {"article", "main"}
# What may stand in a head; any other tag closes a head that was left open.
IN_HEAD = {"base", "link", "meta", "noscript", "script", "style", "template", "title"}
# Boilerplate regions that a page may leave open: a new one or a main region closes them.
OPEN_REGIONS = {"nav", "header", "footer", "aside"}

# Html bytes that a worker has parsed at a time.
SLICE_BYTES = 1 << 20

LINK = T.StructType([T.StructField("href", T.StringType()), T.StructField("text", T.StringType())])
PARSED = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("snippets", T.ArrayType(T.StringType())),
        T.StructField("content", T.StringType()),
        T.StructField("base_href", T.StringType()),
        T.StructField("links", T.ArrayType(LINK)),
    ]
)
PARSED_ARROW = pa.struct(
    [
        ("title", pa.string()),
        ("snippets", pa.list_(pa.string())),
        ("content", pa.string()),
        ("base_href", pa.string()),
        ("links", pa.list_(pa.struct([("href", pa.string()), ("text", pa.string())]))),
    ]
)


class PageParser(HTMLParser):
    def __init__(self, snippet_tag: str):
        super().__init__(convert_charrefs=True)
        self.snippet_tag = snippet_tag
        self.open: list[str] = []
        # How often each tag is open, and how many of them are boilerplate or main regions:
        # the stack itself is never searched without knowing that the tag is there.
        self.count: dict[str, int] = {}
        self.boilerplate = 0
        self.main = 0
        self.title: str | None = None
        self.base_href: str | None = None
        self.snippets: list[str] = []
        self.links: list[dict] = []
        self.link_text: list[str] | None = None
        self.pending: list[str] = []
        self.region: list[str] = []
        self.body: list[str] = []

    def handle_starttag(self, tag, attrs):
        self._flush()
        if self.count.get("head") and tag not in IN_HEAD and tag != "head":
            self._close("head")
        if tag in OPEN_REGIONS or tag in MAIN_REGIONS:
            self._close_regions()
        if tag in SELF_CLOSING:
            self._close_open(tag)
        values = dict(attrs)
        if tag == "base" and self.base_href is None:
            self.base_href = values.get("href")
        if tag in ("a", "area") and values.get("href") is not None:
            self._end_link()
            self.links.append({"href": values["href"], "text": ""})
            self.link_text = [] if tag == "a" else None
        if tag not in VOID_TAGS:
            self._open(tag)
        if tag in BLOCKS:
            self._add_text("\n")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._flush()
        if tag == "a":
            self._end_link()
        if self.count.get(tag):
            self._close(tag)
        if tag in BLOCKS:
            self._add_text("\n")

    def handle_comment(self, data):
        self._flush()

    def handle_data(self, data):
        self.pending.append(data)

    def unknown_decl(self, data):
        """A declaration of another kind of document is skipped."""

    def _open(self, tag):
        self.open.append(tag)
        self.count[tag] = self.count.get(tag, 0) + 1
        self.boilerplate += tag in BOILERPLATE
        self.main += tag in MAIN_REGIONS

    def _pop(self):
        tag = self.open.pop()
        self.count[tag] -= 1
        self.boilerplate -= tag in BOILERPLATE
        self.main -= tag in MAIN_REGIONS
        return tag

    def _close(self, tag):
        """Close the last open ``tag`` and all that was opened since."""
        while self._pop() != tag:
            pass

    def _close_regions(self):
        """Close boilerplate regions that lie directly below the new one, left open by the page."""
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth] in OPEN_REGIONS:
                self._close(self.open[depth])
                return
            if self.open[depth] in CONTAINERS:
                return

    def _close_open(self, tag):
        if not self.count.get(tag):
            return
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth] == tag:
                self._close(tag)
                return
            if self.open[depth] in CONTAINERS:
                return

    def _end_link(self):
        if self.link_text is not None:
            self.links[-1]["text"] = "".join(self.link_text)
            self.link_text = None

    def _flush(self):
        """One text node is complete."""
        if not self.pending:
            return
        text, self.pending = "".join(self.pending), []
        if self.open and self.open[-1] == "title" and self.title is None:
            self.title = text
        if self.open and self.open[-1] == self.snippet_tag and text.strip():
            self.snippets.append(text.strip())
        if self.link_text is not None:
            self.link_text.append(text)
        self._add_text(text)

    def _add_text(self, text):
        if not self.boilerplate:
            self.body.append(text)
            if self.main:
                self.region.append(text)

    def result(self) -> dict:
        self._flush()
        self._end_link()
        return {
            "title": self.title,
            "snippets": self.snippets,
            "content": _tidy(self.region) or _tidy(self.body),
            "base_href": self.base_href,
            "links": self.links,
        }


def _tidy(parts: list[str]) -> str:
    lines = (" ".join(line.split()) for line in "".join(parts).split("\n"))
    return "\n".join(line for line in lines if line)


def parse_page(html: str | None, snippet_tag: str = "code") -> dict:
    """Title, snippets, content and links of a page; of a broken one what came before the break."""
    parser = PageParser(snippet_tag)
    try:
        parser.feed(html or "")
        parser.close()
    except (AssertionError, ValueError):
        # The parser of the standard library raises these on malformed declarations.
        pass
    return parser.result()


def page_slices(batch: pa.RecordBatch, at: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with up to ``size`` bytes of html each, one page at least.

    Parsed pages take several times the memory of their html: a worker holds those of
    one slice, however many rows Spark puts into a batch.
    """
    start = held = 0
    for i, n in enumerate(pc.binary_length(batch.column(at)).fill_null(0).to_pylist()):
        if i > start and held + n > size:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows or not batch.num_rows:
        yield batch.slice(start)


def parse_pages(df: DataFrame, html: str = "html", snippet_tag: str = "code") -> DataFrame:
    """Replace the column ``html`` by the struct column ``parsed``."""
    at = df.columns.index(html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in page_slices(whole, at):
                rows = [parse_page(h, snippet_tag) for h in batch.column(at).to_pylist()]
                columns = [c for i, c in enumerate(batch.columns) if i != at]
                names = [n for i, n in enumerate(batch.schema.names) if i != at]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(rows, PARSED_ARROW)], names=[*names, "parsed"]
                )

    kept = [f for f in df.schema.fields if f.name != html]
    schema = T.StructType([*kept, T.StructField("parsed", PARSED)])
    return df.mapInArrow(run, schema)
