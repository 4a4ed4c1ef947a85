"""Benchmark decontamination with suffix arrays of the training texts.

Documents are worked on in shards of bounded size. A shard's words become their numbers in the benchmark's vocabulary
(others are breaks, as no match can hold them); of its suffixes, those that begin with a stretch of such words as long as
the shortest window are kept, up to the length of a window, and sorted. Every suffix of the benchmark is looked up in the
shard by binary search, which gives all places where its window occurs; windows that follow each other in item and document
are joined to longest verbatim matches. The benchmark goes to the tasks in blocks of a bounded size, whose suffixes each
worker sorts out once; the documents' texts are not shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread, staged
from .words import ALNUM_LOWER, Words, runs, split, text_bytes

WINDOW = 13
#: Bytes of benchmark text that are sent to the tasks at once.
BLOCK_BYTES = 16 << 20
#: Kept suffixes and bytes of text that make a shard.
SHARD_SUFFIXES, SHARD_BYTES = 200_000, 8 << 20
MATCH = "struct<item_id:string,item_at:int,doc_at:int,length:int>"
SCHEMA = f"doc_id long, n_words long, n_hit long, items array<string>, matches array<{MATCH}>"
_MATCH_TYPE = pa.struct([("item_id", pa.string()), ("item_at", pa.int32()), ("doc_at", pa.int32()), ("length", pa.int32())])


class BenchmarkIndex:
    """The suffixes of a block of items, cut to one window each."""

    def __init__(self, item_ids: list[str], texts: list[str], width: int = WINDOW):
        data, offsets = text_bytes(pa.array(texts, pa.string()))
        w = split(data, offsets, ALNUM_LOWER)
        self.width, self.vocabulary = width, np.unique(w.hashes())
        ids = (np.searchsorted(self.vocabulary, w.hashes()) + 1).astype(np.int32)
        counts = w.counts
        sizes = np.minimum(counts, width)
        n = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
        self.item = np.repeat(np.arange(len(texts)), n)
        self.at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        self.length = sizes[self.item]
        self.names = np.array(item_ids, object)
        self.rank = np.unique(np.array([x.encode() for x in item_ids], object), return_inverse=True)[1] if item_ids else np.zeros(0, np.int64)
        self.shortest = int(self.length.min()) if len(self.length) else width
        self.low = self._keys(ids, w.first[self.item] + self.at, self.length)
        raw = np.frombuffer(self.low.tobytes(), np.uint8).reshape(-1, 4 * width).copy()
        raw[np.arange(4 * width)[None] >= 4 * self.length[:, None]] = 255
        self.high = raw.reshape(-1).view(f"S{4 * width}")

    def _keys(self, ids: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The words from each place on, up to its length, as byte strings that sort like the words."""
        step = np.arange(self.width)
        if not len(at):
            return np.zeros(0, f"S{4 * self.width}")
        rows = np.where(step[None] < length[:, None], ids[np.minimum(at[:, None] + step, len(ids) - 1)], 0)
        return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * self.width}").ravel()

    def suffixes(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words that a suffix begins with, document of the run, place) of the suffixes that may hold an item's window."""
        none = (np.zeros(0, f"S{4 * self.width}"), np.zeros(0, np.int64), np.zeros(0, np.int64))
        if not len(w.starts) or not len(self.low):
            return none
        hashes = w.hashes()
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        ids = np.where(self.vocabulary[at] == hashes, at + 1, 0).astype(np.int32)
        # The number of known words from each place on, within the document.
        n = len(ids)
        stops = np.union1d(np.flatnonzero(ids == 0), w.first)
        ahead = stops[np.searchsorted(stops, np.arange(n), "right")]
        ahead = np.where(ids == 0, 0, ahead - np.arange(n))
        places = np.flatnonzero(ahead >= self.shortest)
        if not len(places):
            return none
        doc = np.searchsorted(w.first, places, "right") - 1
        return self._keys(ids, places, np.minimum(ahead[places], self.width)), doc, places - w.first[doc]

    def matches(self, keys: np.ndarray, doc: np.ndarray, doc_at: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, item, place in the item, place in the document, length) of all longest matches of a shard's suffixes."""
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        left, right = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        found = np.maximum(right - left, 0)
        if not found.any():
            return (np.zeros(0, np.int64),) * 5
        which = np.repeat(np.arange(len(found)), found)
        suffix = order[np.repeat(left - (np.cumsum(found) - found), found) + np.arange(int(found.sum()))]
        doc, doc_at = doc[suffix], doc_at[suffix]
        item, item_at, size = self.item[which], self.at[which], self.length[which]
        order = np.lexsort((doc_at, doc_at - item_at, item, doc))
        doc, item, item_at, doc_at, size = (x[order] for x in (doc, item, item_at, doc_at, size))
        follows = np.zeros(len(doc), bool)
        follows[1:] = (doc[1:] == doc[:-1]) & (item[1:] == item[:-1]) & (doc_at[1:] - item_at[1:] == doc_at[:-1] - item_at[:-1]) & (doc_at[1:] == doc_at[:-1] + 1)
        first = np.flatnonzero(~follows)
        last = np.append(first[1:], len(doc)) - 1
        doc, item, item_at, doc_at, size = doc[first], item[first], item_at[first], doc_at[first], doc_at[last] - doc_at[first] + size[last]
        # Items of one id in one order, so that matches do not tell how the items were cut into blocks.
        order = np.lexsort((size, doc_at, doc_at - item_at, self.rank[item], doc))
        return doc[order], item[order], item_at[order], doc_at[order], size[order]

    def scan(self, batches: Iterator[pa.RecordBatch], column: int, keep: list[int]) -> Iterator[tuple[pa.Table, np.ndarray, list[list[tuple]]]]:
        """For each shard: its rows in the columns ``keep``, the number of words and the matches of each row."""
        held: list[pa.RecordBatch] = []
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        counts: list[np.ndarray] = []
        rows = size = found = 0

        def shard() -> tuple[pa.Table, np.ndarray, list[list[tuple]]]:
            out: list[list[tuple]] = [[] for _ in range(rows)]
            if found:
                doc, item, item_at, doc_at, length = self.matches(*map(np.concatenate, zip(*parts, strict=True)))
                for i, *m in zip(doc.tolist(), self.names[item], item_at.tolist(), doc_at.tolist(), length.tolist(), strict=True):
                    out[i].append(tuple(m))
            return pa.Table.from_batches(held), np.concatenate(counts), out

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch.select(keep))
            for a, _, data, offsets in runs(*text_bytes(batch.column(column))):
                w = split(data, offsets, ALNUM_LOWER)
                keys, doc, doc_at = self.suffixes(w)
                if len(keys):
                    parts.append((keys, doc + rows + a, doc_at))
                counts.append(w.counts)
                size, found = size + len(data), found + len(keys)
            rows += batch.num_rows
            if found >= SHARD_SUFFIXES or size >= SHARD_BYTES:
                yield shard()
                held, parts, counts, rows, size, found = [], [], [], 0, 0, 0
        if held:
            yield shard()


_indexes: dict[str, BenchmarkIndex] = {}


def worker_index(name: str, item_ids: list[str], texts: list[str], width: int) -> BenchmarkIndex:
    """This worker's index of a block; that of the last block is kept."""
    if name not in _indexes:
        _indexes.clear()
        _indexes[name] = BenchmarkIndex(item_ids, texts, width)
    return _indexes[name]


def covered(matches: list[tuple]) -> int:
    """Words under at least one match."""
    n = upto = 0
    for at, length in sorted((m[2], m[3]) for m in matches):
        n += max(0, at + length - max(at, upto))
        upto = max(upto, at + length)
    return n


def is_contaminated(n_words: int, n_hit: int) -> bool:
    """Whether hit words are at least a twentieth of the words."""
    return n_hit > 0 and 20 * n_hit >= n_words


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> list[DataFrame]:
    """Items of some id and text, in blocks of about BLOCK_BYTES."""
    items = benchmark.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text")).distinct()
    n = max(1, -(-int(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    return [items] if n == 1 else [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def _index(block: DataFrame, width: int) -> Callable[[], BenchmarkIndex]:
    """A function that gives a worker the block's index."""
    rows = block.orderBy("item_id", "text").collect()  # at most about BLOCK_BYTES
    name, ids, texts = uuid.uuid4().hex, [r[0] for r in rows], [r[1] for r in rows]
    return lambda: worker_index(name, ids, texts, width)


#: Two hashes of a text, by which blocks' rows are put together.
HASHES = {"__text_hash_a": lambda text: F.xxhash64(text), "__text_hash_b": lambda text: F.xxhash64(F.lit("b"), text)}


def _hashed(df: DataFrame, text_col: str) -> DataFrame:
    return df.withColumns({k: f(F.col(text_col)) for k, f in HASHES.items()})


def contamination(docs: DataFrame, benchmark: DataFrame, *, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, items (ids as strings, sorted), matches, contaminated.

    Words are runs of ASCII letters and digits and non-ASCII characters, A-Z lower-cased; null and empty texts have none.
    Items of null id or text, or without words, match nothing; items of fewer than ``width`` words match as wholes. Rows of
    ``benchmark`` that repeat count once. With a benchmark of more than one block, rows of ``docs`` alike in id and text
    (by 128 bits of hashes) are judged together and given back as often as they came. Other columns are not read.
    """
    out = _judged(docs, benchmark_blocks(benchmark, item_col, item_text_col), width, id_col, text_col)
    return out.drop(*HASHES)


def _judged(docs: DataFrame, blocks: list[DataFrame], width: int, id_col: str, text_col: str) -> DataFrame:
    """Rows of ``contamination``, with the text's hashes where there is more than one block."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def scanned(index: Callable[[], BenchmarkIndex], hashed: bool) -> DataFrame:
        more = list(HASHES) if hashed else []

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for held, counts, found in index().scan(batches, 1, [0, *range(2, 2 + len(more))]):
                columns = {
                    "doc_id": held["doc_id"], "n_words": pa.array(counts.astype(np.int64)), "n_hit": pa.array([covered(m) for m in found], pa.int64()),
                    "items": pa.array([sorted({x[0] for x in m}) for m in found], pa.list_(pa.string())),
                    "matches": pa.array([[dict(zip(("item_id", "item_at", "doc_at", "length"), x, strict=True)) for x in m] for m in found], pa.list_(_MATCH_TYPE)),
                }
                yield from pa.table(columns | {k: held[k] for k in more}).to_batches(max_chunksize=4096)

        return spread(_hashed(rows, "text") if more else rows).mapInArrow(run, SCHEMA + "".join(f", {k} long" for k in more))

    if len(blocks) == 1:
        out = scanned(_index(blocks[0], width), False)
    else:
        parts = [staged(scanned(_index(b, width), True).withColumn("block", F.lit(i)), "matches") for i, b in enumerate(blocks)]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        once = every.groupBy("doc_id", *HASHES, "block").agg(
            F.count("*").alias("rows"), F.max("n_words").alias("n_words"), F.first("items").alias("items"), F.first("matches").alias("matches")
        )
        merged = once.groupBy("doc_id", *HASHES).agg(
            F.max("rows").alias("rows"), F.max("n_words").alias("n_words"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.flatten(F.collect_list("matches")).alias("matches"),
        )
        key = lambda m: F.struct(m["item_id"].alias("i"), (m["doc_at"] - m["item_at"]).alias("d"), m["doc_at"].alias("a"), m["length"].alias("n"), m.alias("m"))
        merged = merged.withColumn("matches", F.transform(F.array_sort(F.transform("matches", key)), lambda k: k["m"]))
        spans = F.array_sort(F.transform("matches", lambda m: F.struct(m["doc_at"].alias("a"), (m["doc_at"] + m["length"]).alias("b"))))
        fold = F.aggregate(
            spans,
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
            lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["upto"]))).alias("n"), F.greatest(s["upto"], x["b"]).alias("upto")),
            lambda s: s["n"].cast("long"),
        )
        out = merged.select("doc_id", "n_words", fold.alias("n_hit"), "items", "matches", "rows", *HASHES)
        out = out.withColumn("rows", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).drop("rows")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, width: int = WINDOW, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs``, all columns of any name, without the contaminated rows; each row is judged by its own text.

    Null texts, and texts without words, stay; rows alike in text stay or go together; very long texts are judged whole, and
    no rows give none. Of the benchmark, rows of null id or text and items without words match nothing.
    """
    blocks = benchmark_blocks(benchmark, item_col, item_text_col)
    if len(blocks) > 1:
        texts = docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        bad = _judged(texts, blocks, width, "doc_id", "text").filter("contaminated").select(*HASHES).distinct()
        return _hashed(docs, text_col).join(bad, list(HASHES), "left_anti").select(*docs.columns)
    index, column = _index(blocks[0], width), docs.columns.index(text_col)
    every = list(range(len(docs.columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, counts, found in index().scan(batches, column, every):
            keep = pa.array([not is_contaminated(int(n), covered(m)) for n, m in zip(counts.tolist(), found, strict=True)], pa.bool_())
            yield from held.filter(keep).to_batches()

    return spread(docs).mapInArrow(run, docs.schema)
