"""Exact top-k inner products over a bit-sliced index.

A component x becomes the integer floor(scale * x). The index holds blocks of rows; in a block, slice j of a dimension is
a bitmap over the rows of bit j of that dimension's value (less the block's smallest). For a query, the slices are added
with its weights by bitmap arithmetic, which gives the scores of all rows of the block as slices. From the most
significant slice downward, rows are taken or ruled out whole words at a time; rows that tie at the border are resolved by
the smaller id. Dimensions are added in groups of four, the sums of each subset of a group being made once for a block.

Queries meet every block, in packed blocks of their own; nothing is broadcast and no pair of rows becomes a Spark row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Rows of an index block, queries of a query block, and 64-bit words worked on at once (queries times bitmap words).
BLOCK_ROWS, QUERY_ROWS, WORK_WORDS = 16384, 512, 4096
GROUP = 4
INDEX_SCHEMA = "block string, ids binary, low long, bits int, dims int, slices binary"
HITS_SCHEMA = "query_id long, vec_id long, score long"
_ONE = np.uint64(1)


def quantised(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles."""
    return np.floor(scale * values.astype(np.float64)).astype(np.int64)


def add(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Sum of two unsigned numbers given as slices, least significant first."""
    if len(a) < len(b):
        a, b = b, a
    out, carry = [], None
    for i, x in enumerate(a):
        if i < len(b):
            y = b[i]
            half = x ^ y
            if carry is None:
                out.append(half)
                carry = x & y
            else:
                out.append(half ^ carry)
                carry = (x & y) | (half & carry)
        elif carry is None:
            out.append(x)
        else:
            out.append(x ^ carry)
            carry = x & carry
    if carry is not None:
        out.append(carry)
    return out


def subtract(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """a - b as two's complement slices; the last is the sign."""
    width = max(len(a), len(b)) + 1
    zero = np.zeros(1, np.uint64)
    out, borrow = [], np.zeros(1, np.uint64)
    for i in range(width):
        x = a[i] if i < len(a) else zero
        y = b[i] if i < len(b) else zero
        half = x ^ y
        out.append(half ^ borrow)
        borrow = (~x & y) | (~half & borrow)
    return out


def pack(ids: np.ndarray, values: np.ndarray) -> tuple[int, int, np.ndarray]:
    """(smallest value, bits, slices[dimension, bit, word]) of a block whose rows are in order of id."""
    low = int(values.min())
    bits = max(1, int(values.max() - low).bit_length())
    n, dims = values.shape
    words = (n + 63) // 64
    padded = np.zeros((words * 64, dims), np.uint64)
    padded[:n] = (values - low).astype(np.uint64)
    out = np.empty((dims, bits, words), np.uint64)
    for j in range(bits):
        plane = ((padded >> np.uint64(j)) & _ONE).astype(np.uint8).T
        out[:, j] = np.packbits(np.ascontiguousarray(plane), axis=1, bitorder="little").view(np.uint64)
    return low, bits, out


def subset_sums(slices: np.ndarray) -> list[np.ndarray]:
    """For each group of dimensions, an array [slice, subset, word] of the sums of its subsets."""
    out = []
    for g in range(0, len(slices), GROUP):
        members = slices[g : g + GROUP]
        sums: list[list[np.ndarray]] = [[]]
        for s in range(1, 1 << len(members)):
            top = s.bit_length() - 1
            rest = sums[s ^ (1 << top)]
            own = list(members[top])
            sums.append(add(own, rest) if rest else own)
        width = max(len(x) for x in sums)
        table = np.zeros((width, len(sums), slices.shape[2]), np.uint64)
        for s, x in enumerate(sums):
            for j, plane in enumerate(x):
                table[j, s] = plane
        out.append(table)
    return out


def score_slices(tables: list[np.ndarray], queries: np.ndarray) -> list[np.ndarray]:
    """Slices [query, word] of sum over dimensions of query * value, two's complement, sign last."""
    bits = max(int(queries.max()).bit_length(), int(~queries.min()).bit_length() if queries.min() < 0 else 0)
    total: list[np.ndarray] = []
    minus: list[np.ndarray] = []
    for plane in range(bits, -1, -1):
        here: list[np.ndarray] = []
        for g, table in enumerate(tables):
            q = queries[:, g * GROUP : (g + 1) * GROUP]
            subset = (((q >> plane) & 1) << np.arange(q.shape[1])).sum(axis=1)
            if not subset.any():
                continue
            own = [table[j][subset] for j in range(len(table))]
            if plane == bits:
                minus = add(minus, own) if minus else own
            elif total:
                total = add(total, own)
            else:
                total = own
        if plane and plane < bits and total:
            total = [np.zeros_like(total[0]), *total]
    if minus:
        minus = [np.zeros_like(minus[0])] * bits + minus
    if not total:
        total = [np.zeros((len(queries), tables[0].shape[2]), np.uint64)]
    return subtract(total, minus)


def top(slices: list[np.ndarray], allowed: np.ndarray, k: int) -> np.ndarray:
    """Bitmaps [query, word] of the k highest rows among ``allowed``, ties to the lower row, or of all if fewer."""
    taken, open_ = np.zeros_like(allowed), allowed.copy()
    for j in range(len(slices) - 1, -1, -1):
        plane = ~slices[j] if j == len(slices) - 1 else slices[j]
        high = open_ & plane
        count = np.bitwise_count(taken | high).sum(axis=1)[:, None]
        taken = np.where(count <= k, taken | high, taken)
        open_ = np.where(count <= k, open_ & ~plane, high)
    for q in range(len(taken)):  # rows that tie at the border
        need = k - int(np.bitwise_count(taken[q]).sum())
        if need > 0:
            rows = np.flatnonzero(np.unpackbits(open_[q].view(np.uint8), bitorder="little"))[:need].astype(np.uint64)
            np.bitwise_or.at(taken[q], (rows >> np.uint64(6)).astype(np.int64), _ONE << (rows & np.uint64(63)))
    return taken


def search_block(ids: np.ndarray, low: int, slices: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, row ids, scores) of the best rows of one block."""
    tables, words = subset_sums(slices), slices.shape[2]
    valid = np.zeros(words * 64, np.uint8)
    valid[: len(ids)] = 1
    valid = np.packbits(valid, bitorder="little").view(np.uint64)
    step = max(1, WORK_WORDS // words)
    for a in range(0, len(queries), step):
        q, of = queries[a : a + step], query_ids[a : a + step]
        planes = score_slices(tables, q)
        planes = [np.broadcast_to(p, (len(q), words)) for p in planes]
        allowed = np.repeat(valid[None], len(q), axis=0)
        left, right = np.searchsorted(ids, of, "left"), np.searchsorted(ids, of, "right")
        for i in np.flatnonzero(right > left):
            for r in range(left[i], right[i]):
                allowed[i, r >> 6] &= ~(_ONE << np.uint64(r & 63))
        best = top(planes, allowed, k)
        qi, row = np.nonzero(np.unpackbits(best.view(np.uint8), axis=1, bitorder="little"))
        word, bit = row >> 6, (row & 63).astype(np.uint64)
        score = np.zeros(len(row), np.int64)
        for j, p in enumerate(planes):
            has = ((p[qi, word] >> bit) & _ONE).astype(np.int64) << j
            score += -has if j == len(planes) - 1 else has
        yield of[qi], ids[row], score + low * q.sum(axis=1)[qi]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (doubles), dims of the rows that take part."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad).select(
        F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"), F.size(v).alias("dims")
    )


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def build_index(rows: DataFrame, scale: int, blocks: int) -> DataFrame:
    """One row per block of ``usable`` rows, by hash of the id."""

    def build(table: pa.Table) -> pa.Table:
        ids, dims = table["vec_id"].to_numpy(), table["dims"][0].as_py()
        order = np.argsort(ids, kind="stable")
        low, bits, slices = pack(ids[order], quantised(_matrix(table["v"], dims)[order], scale))
        return pa.table({"block": table["block"][:1], "ids": [ids[order].astype("<i8").tobytes()], "low": [low], "bits": pa.array([bits], pa.int32()), "dims": pa.array([dims], pa.int32()), "slices": [slices.tobytes()]})

    block = F.concat_ws("/", "dims", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    return rows.withColumn("block", block).groupBy("block").applyInArrow(build, INDEX_SCHEMA)


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` highest integer inner products, ties to the smaller id.

    Queries are the rows for which ``is_query``, a condition on ``vec_id``, holds; a query's candidates are all rows of
    another id and as many components. Rows of null id and vectors null, empty, or holding null or non-finite components
    take no part. Rows that share an id are candidates each; a query id of several rows is answered for the first by its
    components. Scores are 64-bit integers, so components must be below about 2**25 in size for vectors of a thousand of them.
    No rows: no answers. Other columns are not read.
    """
    rows = usable(vectors, id_col, vector_col)
    count = rows.count()
    blocks = max(1, -(-count // BLOCK_ROWS))
    index = build_index(rows, scale, blocks)
    asked = rows.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dims", F.size("v"))
    groups = max(1, -(-asked.count() // QUERY_ROWS))

    def pack_queries(table: pa.Table) -> pa.Table:
        dims = table["dims"][0].as_py()
        q = quantised(_matrix(table["v"], dims), scale).astype("<i8")
        return pa.table({"dims": pa.array([dims], pa.int32()), "asked": table["asked"][:1], "query_ids": [table["vec_id"].to_numpy().astype("<i8").tobytes()], "queries": [q.tobytes()]})

    packed = (
        asked.withColumn("asked", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)))
        .groupBy("dims", "asked")
        .applyInArrow(pack_queries, "dims int, asked long, query_ids binary, queries binary")
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .withColumn("block", F.concat_ws("/", "dims", "block"))
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                ids = np.frombuffer(x["ids"], "<i8")
                slices = np.frombuffer(x["slices"], np.uint64).reshape(x["dims"], x["bits"], -1)
                of, q = np.frombuffer(x["query_ids"], "<i8"), np.frombuffer(x["queries"], "<i8").reshape(-1, x["dims"])
                for a, b, c in search_block(ids, x["low"], slices, of, q, k):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], names=["query_id", "vec_id", "score"])

    cells = packed.drop("dims").join(index, "block").repartition(F.col("block"), F.col("asked"))
    hits = cells.select("ids", "low", "bits", "dims", "slices", "query_ids", "queries").mapInArrow(search, HITS_SCHEMA)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT for x in embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.vec_id % 20 = 0 AND len(a.q) = len(b.q)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
