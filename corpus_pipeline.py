"""A corpus pipeline: toxicity, near duplicates, decontamination, mixing, token tables.

Each stage calls one operator on all that the stage before it kept, and its decisions take effect. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from webextract.llm import decontamination, jaccard_join, mixing, token_tables, toxicity
from webextract.llm.queries import tokenizer_path
from webextract.session import staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more for toxicity go; labels teach the model, outside the held-out fifth.

    Every row is judged by its own whole text, so repeated rows stay or go together; null and empty texts get the score of an
    empty text. No rows give none.
    """
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the smallest id.

    Null and empty texts are near nothing and stay; of exact copies, rows that repeat an id too, one stays; very long texts
    are compared whole. No rows give none.
    """
    return jaccard_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go.

    Every row is judged by its own whole text; null and empty texts stay, repeated rows stay or go together, and an empty
    benchmark takes nothing. No rows give none.
    """
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources has it, 0 to 2 times.

    Repeated rows have shares of their own, null sources are a source, and documents without words (null, empty) come with
    the passes that end before the budget does. No rows give none.
    """
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token tables, read back: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts have the end id only, very long ones are one row, rows of one id are in the order of their texts,
    those of no id come first. No rows give none.
    """
    return token_tables.with_crc(token_tables.token_table(docs, tokenizer_path()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("source_mix", mix_sources),
    ("token_tables", write_tokens),
]

#: A trained model, links of links and a tokenizer have no SQL; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
