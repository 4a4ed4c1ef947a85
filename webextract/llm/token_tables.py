"""Token ids as Parquet: list columns, dictionary-coded pages, set row groups, page indexes.

Rows are in ascending doc_id order, over files that hold consecutive ranges of it, so a reader that wants a few
documents skips files and row groups by their statistics and pages by the column index, and a reader of metadata reads
no ids. Spark's own Parquet writer commits the files, so lost tasks are written again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import new_path
from .encoding import PartEncoder
from .words import runs, text_bytes

#: Bytes of a row group and of a page, and bytes up to which a column chunk's dictionary may grow (50,000 ids take 200 kB).
ROW_GROUP_BYTES, PAGE_BYTES, DICTIONARY_BYTES = 16 << 20, 64 << 10, 2 << 20
#: Bytes of text whose ids go to one file, at most about.
FILE_BYTES = 256 << 20
#: Files up to which the table of files is broadcast (a few hundred bytes each).
FILES_TO_BROADCAST = 20_000

TOKENS_SCHEMA = "doc_id long, part_start long, n_tokens long, ids array<int>"


def load_tokenizer(path: str):
    """A tokenizer of the tokenizers library, without truncation or padding."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


_encoders: dict[str, PartEncoder] = {}


def part_encoder(path: str) -> PartEncoder:
    """This worker's encoder: later tasks find the parts that earlier ones have met."""
    if path not in _encoders:
        _encoders[path] = PartEncoder(load_tokenizer(path))
    return _encoders[path]


def write_token_table(docs: DataFrame, path: str, tokenizer_path: str, *, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts, append ``end_id``, and write the table at ``path`` in ascending ``id_col`` order.

    Null texts count as empty. Rows of null id come first. Rows that share an id are ordered by their text. ``part_start``
    is the number of ids before a document in its file. No rows make a table of no rows.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, start = part_encoder(tokenizer_path), 0
        for batch in batches:
            for low, high, data, offsets in runs(*text_bytes(batch.column(1))):
                ids, sizes = encoder.encode(data, offsets)
                ids = np.insert(ids, np.cumsum(sizes), end_id).astype(np.int32)
                at = np.concatenate([[0], np.cumsum(sizes + 1)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(at[:-1] + start), pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))],
                    names=["doc_id", "part_start", "n_tokens", "ids"],
                )
                start += int(at[-1])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    files = -(-int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // FILE_BYTES)
    usual = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(files, "doc_id") if files > usual else rows.repartitionByRange("doc_id")
    ordered = ranged.sortWithinPartitions("doc_id", "text")
    (
        ordered.mapInArrow(encode, TOKENS_SCHEMA)
        .write.option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.dictionary.page.size", DICTIONARY_BYTES)
        .option("parquet.enable.dictionary", "true")
        .option("parquet.page.write-checksum.enabled", "true")
        .option("compression", "zstd")
        .parquet(path)
    )


def read_token_table(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens, ids, start: ids of all documents before it in the whole table.

    A filter on doc_id reaches the scan; without ``ids``, that column is not read.
    """
    rows = spark.read.schema(TOKENS_SCHEMA).parquet(path).withColumn("file", F.col("_metadata.file_name"))
    files = rows.groupBy("file").agg(F.min("doc_id").alias("low"), F.sum("n_tokens").alias("tokens"))
    before = W.orderBy(F.col("low").asc_nulls_first(), "file").rowsBetween(W.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("file_start"))
    if files.count() <= FILES_TO_BROADCAST:
        files = F.broadcast(files)
    return rows.join(files, "file").select("doc_id", (F.col("file_start") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def token_table(docs: DataFrame, tokenizer_path: str, path: str | None = None, **names) -> DataFrame:
    """Write the table (in the shared folder unless ``path`` is given) and read it back."""
    path = path or new_path(docs.sparkSession, "tokens")
    write_token_table(docs, path, tokenizer_path, **names)
    return read_token_table(docs.sparkSession, path)


def with_crc(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of a token table's rows."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            values = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            at = lists.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            sizes = pa.array(np.diff(at).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), sizes, pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "ids").mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
