"""From raw documents to token ids: quality rules, near duplicates, repeated passages, mix, pieces.

Every stage takes what its predecessor kept.  All but the last return the columns of
the documents table: ``doc_id, text, lang, source, n_chars``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siterank.llm import mixing, pieces, quality, setjoin, suffixes
from siterank.llm.catalog import tokenizer_file
from siterank.llm.tables import table
from siterank.session import scratch_path, ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def as_documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, with the length of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the rules and the line labels keep."""
    model = quality.fit_line_model(docs, table(ship_package(spark), sf_dir, "labels"))
    return quality.quality_rules(docs.select(*COLUMNS), model).filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the document with the smallest id.

    Rows of that id with equal texts are one document; without any id in a group, equal
    texts are kept once.
    """
    ship_package(spark)
    first = setjoin.near_duplicates(docs.select(*COLUMNS)).filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
    return first.dropDuplicates(["doc_id", "class_id", "text"]).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of 400 bytes that stand elsewhere as well."""
    ship_package(spark)
    left = suffixes.deduplicate(docs.select(*COLUMNS), with_text=True)
    return as_documents(left.withColumn("text", F.col("kept_text")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row for every time a document is taken, always whole.

    The last document of a source is taken if that brings the source nearer to its target.
    """
    ship_package(spark)
    placed = mixing.mix_sources(docs.select(*COLUMNS))
    return as_documents(mixing.whole_documents(placed, COLUMNS))


def mix_differences(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """By how many words the mix of these documents misses the target of each source."""
    ship_package(spark)
    return mixing.source_differences(mixing.mix_sources(docs.select("doc_id", "source", "text")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document and the digests of ids and decoded text."""
    ship_package(spark)
    coded = pieces.encode_pieces(docs.select("doc_id", "source", "text"), tokenizer_file("piece_bpe_32k.model"))
    return coded.drop("text")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources", mix),
    ("SentencePiece encoding", encode),
]

#: The line labels and the near duplicates are not for SQL; the tests have the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
