"""Queries and SQL of the llm operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import chat_format, decontamination, jaccard_join, mixing, secret_scan, substring_dedup, token_tables, topk_search, toxicity, url_filters

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(f):
    """Register a query by its function's name."""
    QUERIES[f.__name__] = f
    return f


@query
def op1_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the list entries active when it was fetched; the entries are made from the pages' own hosts."""
    pages = table(spark, sf_dir, "pages").withColumn("fetched_at", url_filters.fetch_time(F.col("page_id")))
    found = url_filters.filter_captures(pages, url_filters.made_entries(pages), id_col="page_id", url_col="url", time_col="fetched_at")
    return found.withColumnRenamed("capture_id", "page_id")


ORACLES["op1_url_lists"] = url_filters.SQL


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents with a model learnt from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents."""
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


@query
def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents to target weights."""
    mixed = mixing.fair_mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op4_source_mix"] = mixing.SQL


@query
def op5_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows for each vector whose id is divisible by 20."""
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLES["op5_bit_sliced_topk"] = topk_search.SQL


@query
def op6_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r"""Format all conversations, and -7, whose texts look like control strings."""
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.read_back(chat_format.format_conversations(turns, tokenizer_path()))


@query
def op7_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents, write them as a token table and read it back."""
    return token_tables.with_crc(token_tables.token_table(table(spark, sf_dir, "documents"), tokenizer_path()))


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages that a document of smaller id has."""
    kept = substring_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, plain and encoded."""
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
