"""Near-duplicate groups by word-shingle Jaccard similarity: a parity-sketch join.

Documents of one shingle set form a class, known by two 64-bit sums over the set; classes are joined, copies are not.
Shingles are dealt by hash to the blocks of a sketch and XORed there. Two sets that differ in d shingles differ in at most
d blocks, and a similarity of t allows d <= (1 - t) / (1 + t) * (|A| + |B|). So, with the keys of all blocks put in one
order, the first d + 1 of two linked sets have one in common (pigeonhole): these are joined, within bands of set size of
1 : 2 (a set that may have a partner in the next band joins there too). Bands of small sets have a block for each shingle.
In larger bands a set has fewer than d + 1 filled blocks with a chance below 1e-14.

The blocks' keys travel packed, one row per run of texts and bucket. Sets that share a key form a group. The order of keys
is that of their groups' size, so each set leaves the largest groups it can: those of passages that many documents hold
keep only the sets that consist of such passages for the greater part.

First each group's smallest member is compared with the others, and what is linked is put together; then members of a
group that are still apart are compared with each other. So a group of any number of near copies costs as many comparisons
as it has members. A comparison first takes the Hamming distance of the sets' parity bit sketches, a lower bound of the
symmetric difference, and then, of the pairs left, the sets themselves. Large groups of one smallest member hold much the
same sets, so these are compared as one; there the sets are compared in the task too, which gives a tree of links for
each part it finds and not all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import release, spread, staged
from .components import connected_components
from .words import SPACED_LOWER, mix, runs, split, text_bytes, windows

WIDTH = 5
#: Similarity as a fraction.
OVER, UNDER = 75, 100
#: Bytes of text whose keys one bucket takes, and the least number of buckets (a power of two).
BUCKET_BYTES, LEAST_BUCKETS = 32 << 20, 64
#: Bytes kept of a key within its bucket. Keys that fall together make a group larger, which costs a comparison only.
KEY_BYTES = 5
#: Members of a group that are compared with its smallest one in one task, and members of a small group.
DEALT, SMALL_GROUP = 1024, 32
#: Bands below 2**SMALL have a block for each shingle.
SMALL = 6
#: Bits of a parity sketch for each shingle, about.
SKETCH_BITS = 4
#: Members compared with each other in one task: of the smaller parts, and of all; fewer where their sets take more bytes.
BLOCK, BLOCK_BYTES = (128, 1024), 32 << 20
#: Partners compared with a set in one task, and ids up to which a list of wanted documents is broadcast (8 bytes each).
PARTNERS, IDS_TO_BROADCAST = 256, 1_000_000

SETS_SCHEMA = "doc_id long, h1 long, h2 long, n long, c1 long, c2 long, spare0 long, spare1 long"


class Sets:
    """Distinct shingles of each text of a run, in rising order of hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        w = split(data, offsets, SPACED_LOWER)
        hashes, good = windows(w.hashes(), w.first, WIDTH, short=True)
        of, hashes = w.text_of()[good], hashes[good]
        order = np.lexsort((hashes, of))
        of, hashes = of[order], hashes[order]
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])
        self.of, self.hashes = of[new], hashes[new]
        self.n = np.bincount(self.of, minlength=len(offsets) - 1)
        self.first = np.concatenate([[0], np.cumsum(self.n)])

    def sums(self, seed: int) -> np.ndarray:
        """A 64-bit sum over each set, as int64."""
        total = np.zeros(len(self.hashes) + 1, np.uint64)
        np.cumsum(mix(self.hashes, seed), out=total[1:])
        return (total[self.first[1:]] - total[self.first[:-1]]).view(np.int64)

    def each(self) -> list[np.ndarray]:
        """The hashes of each text."""
        return [self.hashes[a:b] for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True)]

    def keys(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(text, key) of all filled blocks, over both bands of each text, and for each parity of a band and each text how
        many of its keys need not be joined.

        A key's lowest bit is that of its band. Only its kept bytes tell a text's own keys apart.
        """
        n, level = self.n, np.floor(np.log2(np.maximum(self.n, 1))).astype(np.int64)
        found, spare = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))], [np.zeros(len(n), np.int64) for _ in (0, 1)]
        for up in (0, 1):
            band = level + up
            top = n * UNDER // OVER  # the largest partner
            differ = (n + (np.minimum(top, (2 << band) - 1) if not up else top)) * (UNDER - OVER) // (UNDER + OVER)
            joins = (n > 0) if not up else (n > 0) & (top >= (1 << band))
            take = joins[self.of]
            of, h = self.of[take], self.hashes[take]
            if not len(of):
                continue
            blocks = (1 << band)[of].astype(np.uint64)
            block = np.where(band[of] < SMALL, h, ((h >> np.uint64(32)) * blocks) >> np.uint64(32))
            new = np.ones(len(of), bool)
            new[1:] = (of[1:] != of[:-1]) | (block[1:] != block[:-1])
            start = np.flatnonzero(new)
            parity = np.bitwise_xor.reduceat(mix(h, 22), start)
            of, block = of[start], block[start]
            key = mix(parity + mix(block, 23) + mix(band[of].astype(np.uint64), 24))
            key = (key & ~np.uint64(1)) | (band[of] & 1).astype(np.uint64)
            kept = key & np.uint64((1 << 8 * KEY_BYTES) - 1)
            order = np.lexsort((kept, of))
            of, key, kept = of[order], key[order], kept[order]
            other = np.ones(len(of), bool)
            other[1:] = (of[1:] != of[:-1]) | (kept[1:] != kept[:-1])
            free = np.where(joins, np.bincount(of[other], minlength=len(n)) - differ - 1, 0)
            for bit in (0, 1):
                spare[bit] = np.where(joins & (band & 1 == bit), free, spare[bit])
            found.append((of, key))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), spare


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Parity bits of a set, as words: SKETCH_BITS for each shingle and up to twice as many, 64 at least."""
    bits = max(64, 1 << int(SKETCH_BITS * max(1, len(hashes)) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.uint64)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets are linked."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return UNDER * both >= OVER * (len(x) + len(y) - both)


def text_hashes(text: Column) -> list[Column]:
    """Two hashes that tell the texts of one id apart."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("h2"), text).alias("h2")]


def shingle_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, two hashes of the text, n, class (c1, c2), and the number of keys not to be joined in even and odd bands, of
    each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in runs(*text_bytes(batch.column(1))):
                s = Sets(data, offsets)
                columns = [s.n.astype(np.int64), s.sums(11), s.sums(12), *s.keys()[2]]
                own = [batch.column(k).slice(a, b - a) for k in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays([*own, *map(pa.array, columns)], names=["doc_id", "h1", "h2", "n", "c1", "c2", "spare0", "spare1"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *text_hashes(F.col(text_col)))
    return spread(rows).mapInArrow(run, SETS_SCHEMA)


def packed_keys(docs: DataFrame, buckets: int, text_col: str) -> DataFrame:
    """(bucket, classes, counts, keys): for each run of texts, the keys of a bucket in the order of their classes.

    A class goes by its first sum here; classes that have it in common are told apart again later.
    """
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in runs(*text_bytes(batch.column(0))):
                s = Sets(data, offsets)
                of, key, _ = s.keys()
                classes = s.sums(11)
                bucket = (key >> shift).astype(np.int64)
                order = np.lexsort((of, bucket))
                of, key, bucket = of[order], key[order], bucket[order]
                edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)) if len(bucket) else np.zeros(0, np.int64)
                rows = []
                for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    own, counts = np.unique(of[i:j], return_counts=True)
                    kept = key[i:j].view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()
                    rows.append((int(bucket[i]), classes[own].tobytes(), counts.astype(np.int32).tobytes(), kept))
                if rows:
                    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["bucket", "classes", "counts", "keys"])

    return spread(docs.select(F.col(text_col).alias("text"))).mapInArrow(run, "bucket int, classes binary, counts binary, keys binary")


GROUP_SCHEMA = "gid long, c1 long, bit int, keys long, members long"


def key_groups(packed: DataFrame) -> DataFrame:
    """One row per member of each different group of a bucket: group, class, band's lowest bit, number of keys that have the
    group, and its size."""

    def group(table: pa.Table) -> pa.Table:
        whole = lambda name, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table[name]])
        raw = np.zeros((sum(len(x.as_buffer()) for x in table["keys"]) // KEY_BYTES, 8), np.uint8)
        raw[:, :KEY_BYTES] = whole("keys", np.uint8).reshape(-1, KEY_BYTES)
        keys = raw.view(np.uint64).ravel()
        classes, number = np.unique(whole("classes", np.int64), return_inverse=True)
        of = np.repeat(number.astype(np.int32), whole("counts", np.int32))
        order = np.lexsort((of, keys))
        of, keys = of[order], keys[order]
        fresh = np.ones(len(of), bool)
        fresh[1:] = (of[1:] != of[:-1]) | (keys[1:] != keys[:-1])
        of, keys = of[fresh], keys[fresh]
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(keys)))
        start, size = start[size > 1], size[size > 1]
        bit = (keys[start] & np.uint64(1)).astype(np.int64)
        total = np.zeros(len(of) + 1, np.uint64)
        np.cumsum(mix(classes.view(np.uint64), 32)[of], out=total[1:])
        gid, first, times = np.unique(total[start + size] - total[start] + mix(bit.astype(np.uint64), 33), return_index=True, return_counts=True)
        start, size, bit = start[first], size[first], bit[first]
        member = of[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        each = lambda x: np.repeat(x, size)
        return pa.table({
            "gid": each(gid).view(np.int64), "c1": classes[member], "bit": pa.array(each(bit), pa.int32()), "keys": each(times).astype(np.int64),
            "members": each(size).astype(np.int64),
        })

    return packed.groupBy("bucket").applyInArrow(group, GROUP_SCHEMA)


def least_groups(groups: DataFrame, classes: DataFrame) -> DataFrame:
    """(gid, cid, n, members): each class in its d + 1 keys of the smallest groups.

    A class is in no more groups than it has shingles, so the window over its groups is bounded by a document. All of it
    is done by the class, dealt once.
    """
    groups = groups.repartition("c1").groupBy("gid", "c1", "bit").agg(F.sum("keys").alias("keys"), F.max("members").alias("members"))
    rows = groups.join(classes.select("c1", "cid", "n", "spare0", "spare1"), "c1")
    down = W.partitionBy("c1", "cid", "bit").orderBy(F.desc("members"), F.desc("gid")).rowsBetween(W.unboundedPreceding, 0)
    left = F.sum("keys").over(down) <= F.when(F.col("bit") == 0, F.col("spare0")).otherwise(F.col("spare1"))
    return rows.withColumn("left", left).filter(~F.col("left")).select("gid", "cid", "n", "members")


def with_centers(members: DataFrame) -> DataFrame:
    """(gid, cid, n, a, na, size): ``members`` with the smallest member of their group and its size, 2 at least.

    A group's rows are dealt to several tasks by its first size.
    """
    deals = F.ceil(F.col("members") / DEALT)
    centers = members.groupBy("gid", "members").agg(F.min("cid").alias("a"), F.count("*").alias("size")).filter("size > 1")
    centers = centers.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), deals - 1))).drop("members")
    return members.withColumn("deal", F.pmod(F.xxhash64("cid"), deals)).join(centers, ["gid", "deal"]).select("gid", "cid", "n", "a", "size")


def _folded(x: np.ndarray, words: int) -> np.ndarray:
    """Sketches of a shorter length: halves are XORed."""
    while x.shape[-1] > words:
        half = x.shape[-1] // 2
        x = x[..., :half] ^ x[..., half:]
    return x


def hamming(a: np.ndarray, b: np.ndarray) -> int:
    """Distance of two sketches; the longer is folded to the length of the shorter."""
    words = min(len(a), len(b))
    return int(np.bitwise_count(_folded(a, words) ^ _folded(b, words)).sum())


def most_apart(na, nb):
    """The largest symmetric difference of linked sets of these sizes."""
    return (na + nb) * (UNDER - OVER) // (UNDER + OVER)


def alike(x: Column, y: Column) -> Column:
    """Whether sets of these sizes may be linked."""
    return UNDER * F.least(x, y) >= OVER * F.greatest(x, y)


def _near(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sketches do not rule a link out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = most_apart(batch.column(2).to_numpy(), batch.column(3).to_numpy())
            words = [[np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(k)] for k in (4, 5)]
            far = np.array([hamming(x, y) for x, y in zip(*words, strict=True)], np.int64)
            yield batch.filter(pa.array(far <= most)).select(["a", "b"])

    info = held.select("cid", "n", "sketch")
    rows = pairs.join(info.toDF("a", "na", "sa"), "a").join(info.toDF("b", "nb", "sb"), "b")
    return rows.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def _linked(near: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs of ``near`` (a, b) whose sets are similar enough."""
    near = staged(near, "near")
    many = near.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("chunks"))
    dealt = near.join(many, "a").withColumn("chunk", F.pmod(F.xxhash64("b"), F.col("chunks")))
    wanted = dealt.select("a", "chunk", F.lit(1).alias("side"), F.col("b").alias("cid"))
    wanted = wanted.unionByName(dealt.select("a", "chunk", F.lit(0).alias("side"), F.col("a").alias("cid")).distinct())
    rows = wanted.join(held.select("cid", "hashes"), "cid").repartition("a", "chunk").sortWithinPartitions("a", "chunk", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (side, x) in enumerate(zip(batch.column(2).to_numpy(), batch.column(4), strict=True)):
                x = np.frombuffer(x.as_buffer(), np.uint64)
                if side == 0:
                    own = x.copy()
                else:
                    good[i] = similar(own, x)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in (batch.column(0), batch.column(3))], names=["a", "b"])

    return rows.select("a", "chunk", "side", "cid", "hashes").mapInArrow(run, "a long, b long")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of one or more whole groups from batches in the order of ``keys``."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        ends = tuple(c[-1] for c in columns)
        differs = np.zeros(batch.num_rows, bool)
        for c in columns:
            differs |= c != c[-1]
        at = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        if at or (last is not None and ends != last):
            if held or at:
                yield pa.Table.from_batches([*held, batch.slice(0, at)])
            held, batch = [], batch.slice(at)
        held.append(batch)
        last = ends
    if held:
        yield pa.Table.from_batches(held)


def _edges(table: pa.Table, keys: list[str]) -> list[int]:
    """Where the groups of a table begin, and its end."""
    columns = np.column_stack([table[k].to_numpy() for k in keys])
    return [0, *(np.flatnonzero((columns[1:] != columns[:-1]).any(axis=1)) + 1).tolist(), len(columns)]


def _open(rows: DataFrame, *keys: str) -> DataFrame:
    """Of each group that has members apart: the keys, its largest part (``most``), members in all, in that part, and the
    largest member's size. Parts are summed before groups are, so none meets in one task."""
    parts = rows.groupBy(*keys, "part").agg(F.count("*").alias("count"), F.max("n").alias("n")).groupBy(*keys)
    sizes = parts.agg(F.max_by("part", F.struct("count", "part")).alias("most"), F.sum("count").alias("all"), F.max("count").alias("top"), F.max("n").alias("largest"))
    return sizes.filter(F.col("all") > F.col("top"))


def _near_in_small(rows: DataFrame, held: DataFrame) -> DataFrame:
    """(a, b): members (gid, cid, n, part) of a small group but different parts whose sketches do not rule a link out."""
    rows = rows.join(_open(rows, "gid").select("gid"), "gid").join(held.select("cid", "sketch"), "cid")
    dealt = rows.select("gid", "cid", "n", "part", "sketch").repartition("gid").sortWithinPartitions("gid", "cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["gid"]):
            edges = _edges(table, ["gid"])
            cid, n, part = (table[k].to_numpy() for k in ("cid", "n", "part"))
            words = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["sketch"]]
            out: set[tuple[int, int]] = set()
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                stacks = _Stacks(words, np.arange(low, high))
                for i in range(low, high - 1):
                    for rows in stacks.near(i, words[i], n, part):
                        out.update((int(cid[i]), int(cid[j])) for j in rows[rows > i].tolist())
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


class _Stacks:
    """Sketches of some rows, by length."""

    def __init__(self, words: list[np.ndarray], rows: np.ndarray):
        lengths = np.array([len(words[j]) for j in rows.tolist()])
        self.stacks = [(rows[lengths == k], np.stack([words[j] for j in rows[lengths == k].tolist()])) for k in np.unique(lengths).tolist()]

    def near(self, i: int, own: np.ndarray, n: np.ndarray, part: np.ndarray) -> Iterator[np.ndarray]:
        """Rows of other parts than row i that sizes and sketches do not rule out."""
        for rows, stack in self.stacks:
            fits = (part[rows] != part[i]) & (UNDER * np.minimum(n[rows], n[i]) >= OVER * np.maximum(n[rows], n[i]))
            if fits.any():
                rows, least = rows[fits], min(stack.shape[1], len(own))
                far = np.bitwise_count(_folded(stack[fits], least) ^ _folded(own, least)).sum(axis=1)
                yield rows[far <= most_apart(n[rows], n[i])]


def _links_in_large(rows: DataFrame, held: DataFrame) -> DataFrame:
    """(a, b): links between the members (center, cid, n, part) of one center but different parts that put together all that
    links do.

    Members outside the largest part meet all members, block by block: a block of each side goes to one task. What is
    linked there becomes one part at once, so a task gives fewer links than it has members.
    """
    size = F.greatest(F.col("largest") * 8, F.lit(1))
    block = lambda k: F.least(F.lit(BLOCK[k]), F.greatest(F.lit(8), F.floor(F.lit(BLOCK_BYTES * BLOCK[k] // sum(BLOCK)) / size)))
    blocks = _open(rows, "center").select("center", "most", F.ceil((F.col("all") - F.col("top")) / block(0)).alias("left"), F.ceil(F.col("all") / block(1)).alias("right"))
    rows = rows.join(blocks, "center").join(held.select("cid", "hashes"), "cid")
    own = lambda n: F.pmod(F.xxhash64("cid"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    first = rows.filter(F.col("part") != F.col("most")).withColumn("side", F.lit(0)).withColumn("x", own("left")).withColumn("y", every("right"))
    both = first.unionByName(rows.withColumn("side", F.lit(1)).withColumn("y", own("right")).withColumn("x", every("left")))
    dealt = both.select("center", "x", "y", "side", "cid", "n", "part", "hashes").repartition("center", "x", "y").sortWithinPartitions("center", "x", "y", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["center", "x", "y"]
        for table in whole_groups(batches, keys):
            edges = _edges(table, keys)
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                links = _forest(table.slice(low, high - low))
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _forest(table: pa.Table) -> list[tuple[int, int]]:
    """Links that put together the parts of one block."""
    side, cid, n = (table[k].to_numpy() for k in ("side", "cid", "n"))
    part = np.unique(table["part"].to_numpy(), return_inverse=True)[1]
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["hashes"]]
    words = [sketch(x) for x in sets]
    middle = int(np.searchsorted(side, 1))
    stacks, out = _Stacks(words, np.arange(middle, len(side))), []
    for i in range(middle):
        for rows in stacks.near(i, words[i], n, part):
            for j in rows.tolist():
                if part[i] != part[j] and similar(sets[i], sets[j]):
                    out.append((int(min(cid[i], cid[j])), int(max(cid[i], cid[j]))))
                    part[part == part[j]] = part[i]
    return out


def wanted_texts(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text of the wanted documents, once each: the list is broadcast up to a checked size, else joined."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ids = ids.distinct().withColumnRenamed("id", "wanted")
    if ids.limit(IDS_TO_BROADCAST + 1).count() <= IDS_TO_BROADCAST:
        ids = F.broadcast(ids)
    return rows.join(ids, F.col("id").eqNullSafe(F.col("wanted")), "left_semi")


def _held_sets(wanted: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(cid, n, sketch, hashes) of the classes wanted (cid, c1, c2, rep), from a text of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in runs(*text_bytes(batch.column(0))):
                s = Sets(data, offsets)
                each = s.each()
                columns = [pa.array(s.sums(11)), pa.array(s.sums(12)), pa.array(s.n.astype(np.int64)), pa.array([sketch(x).tobytes() for x in each], pa.binary()), pa.array([x.tobytes() for x in each], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["c1", "c2", "n", "sketch", "hashes"])

    texts = wanted_texts(docs, wanted.select(F.col("rep").alias("id")), id_col, text_col)
    sets = texts.select("text").mapInArrow(run, "c1 long, c2 long, n long, sketch binary, hashes binary")
    found = sets.join(wanted.select("cid", "c1", "c2"), ["c1", "c2"])
    return found.groupBy("cid").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("hashes").alias("hashes"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, the smallest id that links lead to, itself included.

    Words are runs of characters other than white space, A-Z lower-cased; a set is the distinct runs of five words, or all
    words where they are fewer. Null texts, and texts without words, have empty sets and are linked with nothing. Rows that
    share an id are linked as one document each; their component is that of their own text. Rows of null id take part
    in links and keep a null component where these lead to no id. Very long texts are taken whole. No rows give none. Other
    columns are not read.
    """
    return _grouped(docs, id_col, text_col).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, h1, h2, n, component, component_id) of each row."""
    named = staged(shingle_sets(docs, id_col, text_col), "sets")
    classes = named.filter(F.col("n") > 0).groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), *(F.max(c).alias(c) for c in ("n", "spare0", "spare1")))
    classes = staged(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    size = int(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0)
    buckets = LEAST_BUCKETS
    while buckets * BUCKET_BYTES < size:
        buckets *= 2
    members = staged(least_groups(key_groups(packed_keys(docs, buckets, text_col)), classes), "members")
    placed = staged(with_centers(members), "placed")
    held = staged(_held_sets(classes.join(placed.select("cid").distinct(), "cid", "left_semi"), docs, id_col, text_col), "held")

    compared = lambda pairs: _linked(_near(pairs.distinct(), held), held)
    sizes = placed.select("cid", "n").distinct()
    first = placed.filter(F.col("cid") != F.col("a")).select("a", F.col("cid").alias("b"), "n").distinct().join(sizes.toDF("a", "na"), "a").filter(alike(F.col("n"), F.col("na")))
    links = staged(compared(first.select("a", "b")), "links")
    parts = connected_components(links)

    # Members still apart.
    apart = placed.join(parts.withColumnRenamed("node", "cid"), "cid", "left").withColumn("part", F.coalesce("component", "cid"))
    apart = staged(apart.select("gid", F.col("a").alias("center"), "cid", "n", "part", (F.col("size") > SMALL_GROUP).alias("large")), "apart")
    more = _links_in_large(apart.filter("large").select("center", "cid", "n", "part").distinct(), held)
    more = staged(more.unionByName(_linked(_near_in_small(apart.filter(~F.col("large")), held).distinct(), held)), "links")
    if not more.isEmpty():
        parts = connected_components(links.unionByName(more))

    release(members, placed, held, apart, links, more)
    # The smallest id of each component's classes.
    joined = classes.join(parts.withColumnRenamed("node", "cid"), "cid", "left").select("c1", "c2", "rep", F.coalesce("component", "cid").alias("component"))
    least = joined.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("classes")).filter("classes > 1")
    of_class = joined.join(least.select("component", F.col("component_id").alias("least")), "component", "left").select("c1", "c2", "component", F.coalesce("least", "rep").alias("component_id"))
    component_id = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    return named.join(of_class, ["c1", "c2"], "left").select("doc_id", "h1", "h2", "n", "component", component_id)


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns of any name and type, with one document of each group of near duplicates: that of the smallest id.

    Documents linked with nothing, so those without words (null and empty texts too), stay, and very long texts are taken
    whole. Of several near duplicates of the smallest id, or of no id at all, one stays; which, depends on their texts
    alone, but of rows alike in id and text any one stays. No rows give none.
    """
    near = staged(_grouped(docs, id_col, text_col).filter("n > 0"), "near")
    again = near.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter("count > 1").select("doc_id")
    again = staged(again.unionByName(near.filter(F.col("doc_id").isNull()).select("doc_id").limit(1)), "again")
    gone = near.filter(F.col("component_id") < F.col("doc_id")).join(again, "doc_id", "left_anti").select("doc_id").distinct()

    name = "near_key"
    while any(c.lower().startswith(name) for c in docs.columns):
        name += "_"
    key = F.col(f"`{id_col}`").cast("long")
    small = lambda ids: F.broadcast(ids) if ids.limit(IDS_TO_BROADCAST + 1).count() <= IDS_TO_BROADCAST else ids
    gone = gone.toDF(name)
    kept = docs.join(small(gone), key.eqNullSafe(F.col(name)), "left_anti")
    if again.isEmpty():
        return kept
    # Rows that an id does not tell apart are told apart by their texts.
    shared = near.join(again.toDF("id"), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stays = shared.groupBy("component").agg(F.min("doc_id").alias("id"), F.min(F.struct("h1", "h2")).alias("h")).select("id", "h.h1", "h.h2")
    names = [f"{name}{i}" for i in range(3)]
    again = again.toDF(name)
    plain = kept.join(small(again), key.eqNullSafe(F.col(name)), "left_anti")
    twice = kept.join(small(again), key.eqNullSafe(F.col(name)), "left_semi")
    worded = F.coalesce(F.col(f"`{text_col}`").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = twice.filter(worded).withColumns(dict(zip(names, [key, *text_hashes(F.col(f"`{text_col}`"))], strict=True)))
    first = keyed.join(stays.toDF("a", "b", "c"), F.col(names[0]).eqNullSafe(F.col("a")) & (F.col(names[1]) == F.col("b")) & (F.col(names[2]) == F.col("c")), "left_semi").dropDuplicates(names)
    return plain.unionByName(twice.filter(~worded)).unionByName(first.drop(*names))
