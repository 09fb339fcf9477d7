"""Row types shared by the operators."""

from pyspark.sql import types as T

# One crawled page per JSON line.  The schema must be explicit: inference would
# read ``out_links`` as a struct with one field per URL.
CRAWL_RECORD = T.StructType(
    [
        T.StructField("date", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("code_snippets", T.ArrayType(T.StringType())),
        T.StructField("out_links", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    ]
)

# ``ord`` keeps the line order once records have been rewritten by Spark; the
# domain is the folder.
CRAWL_DATASET = T.StructType(
    CRAWL_RECORD.fields
    + [T.StructField("ord", T.LongType()), T.StructField("crawl_domain", T.StringType())]
)

INDEX_STAT = T.StructType(
    [T.StructField("domain", T.StringType()), T.StructField("n_docs", T.LongType())]
)

CLICK = T.StructType(
    [T.StructField("ts", T.TimestampType()), T.StructField("url", T.StringType())]
)

# URL and title words that mark a documentation page, in probing order.
DOC_KEYWORDS = [
    "doc",
    "docs",
    "document",
    "documentation",
    "documents",
    "manual",
    "manuals",
    "guide",
    "guides",
    "user_guide",
    "userguide",
    "user_guides",
    "userguides",
    "howto",
    "howtos",
    "how-to",
    "how-tos",
    "tutorial",
    "tutorials",
    "reference",
    "references",
    "knowledgebase",
    "faq",
]

# Features that are z-scored per crawl file, in feature-vector order.
NORMALIZED_FEATURES = ["term_in_url", "term_in_title", "content_len", "code_len", "num_in_urls"]

# The z-scores that make up the importance of a page.
IMPORTANCE_FEATURES = ["term_in_url", "term_in_title", "code_len", "content_len"]

# Searched fields and whether their tokens are stemmed.
SEARCH_FIELDS = {
    "url": False,
    "title": True,
    "content": True,
    "code": False,
    "links_texts": True,
}

# Clause boosts of the query expansion.
URL_BOOST = 4.0
TITLE_BOOST = 2.0
CODE_BOOST = 1.5
