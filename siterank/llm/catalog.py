"""The operators of this folder bound to the given tables, with their settings for production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siterank.llm.tables import table
from siterank.session import scratch_path, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(ship_package(spark), folder)

    QUERIES[fn.__name__] = run
    return fn


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op6_token_files(spark, folder):
    from siterank.llm import binary, bytebpe

    path, model = scratch_path(spark, "tokens"), tokenizer_file("byte_bpe_50k.json")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    binary.write_token_files(docs, path, lambda: bytebpe.shared(model, width=2, end=0), width=2)
    return binary.with_starts(binary.read_token_files(spark, path))


@query
def op7_pieces(spark, folder):
    from siterank.llm import pieces

    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pieces.encode_pieces(docs, tokenizer_file("piece_bpe_32k.model")).drop("text")


@query
def op8_quality_lines(spark, folder):
    from siterank.llm import quality

    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.fit_line_model(docs, table(spark, folder, "labels"))
    return quality.quality_rules(docs, model).drop("text")


@query
def op5_mix(spark, folder):
    from siterank.llm import mixing

    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    sized = docs.select("doc_id", "source", mixing.word_count().alias("size"))
    placed = mixing.mix_sources(sized)
    return placed.select("doc_id", "size", "source_size", "target", mixing.taken_words().alias("taken"))


@query
def op10_warc_packages(spark, folder):
    from siterank.llm import warc

    path = scratch_path(spark, "packages")
    warc.write_packages(table(spark, folder, "pages").select("page_id", "url", "html"), path)
    return warc.read_packages(spark, path)


@query
def op1_toxicity(spark, folder):
    from siterank.llm import toxicity

    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, table(spark, folder, "labels"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", (toxicity.fold() == 0).alias("held_out"), "score", "predicted")


@query
def op9_jaccard_join(spark, folder):
    from siterank.llm import setjoin

    docs = table(spark, folder, "documents").select("doc_id", "text")
    return setjoin.near_duplicates(docs).drop("text")


@query
def op4_suffix_dedup(spark, folder):
    from siterank.llm import suffixes

    docs = table(spark, folder, "documents").select("doc_id", "text")
    return suffixes.deduplicate(docs).drop("text")


@query
def op3_prefix_forest(spark, folder):
    from siterank.llm import neighbours

    return neighbours.search(table(spark, folder, "embeddings").select("vec_id", "embedding"))


@query
def op2_label_shards(spark, folder):
    from siterank.llm import sharding

    return sharding.shard_documents(table(spark, folder, "documents").select("doc_id", "text"), shards=8)


@query
def op11_conversation_repair(spark, folder):
    from siterank.llm import repair

    return repair.repair_conversations(table(spark, folder, "conversations"))


@query
def op12_harmonic_packing(spark, folder):
    from siterank.llm import packing

    docs = table(spark, folder, "documents").select("doc_id", "text")
    packed = packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"), end_id=2, capacity=4096)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "used", "class")


@query
def op13_block_search(spark, folder):
    from siterank.llm import lexsearch

    docs = table(spark, folder, "documents").select("doc_id", "text")
    return lexsearch.search(docs, table(spark, folder, "benchmark").select("item_id", "text"), k=10)
