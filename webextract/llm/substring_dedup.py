"""Removing passages that documents repeat: repeated-phrase automata.

A window is 13 consecutive words. Of the documents of a run of texts that have a window, the one of smallest id owns it for
the others: no more is needed to remove it there. So only that one's hash goes on, and a window that any share of all
documents has is in a bucket once for each run. The hashes travel packed, one row per run and bucket; a bucket finds the
windows that more than one run has, and of each its owner, the document of smallest id. The owners' passages are then read
again and confirmed as words: those of a shard of owners are cut into blocks, of which every window holds one whole, and
compiled to an Aho-Corasick automaton over word numbers. Every document that may hold one of them streams through it whole;
of each block found, the words before and behind are compared. An occurrence in a document other than the owner is
removed. A shard with many documents is dealt to several tasks, each with the shard's automaton.

Where two different windows have one hash, only the smallest document's is in an automaton. Windows of the hash that the
automaton does not hold are then told apart by their words, and owned by the smallest document that has them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import release, spread, staged
from .jaccard_join import wanted_texts, whole_groups
from .words import SPACED, runs, split, text_bytes, windows

WINDOW = 13
#: Bytes of text whose windows one bucket takes, and the least number of buckets (a power of two).
BUCKET_BYTES, LEAST_BUCKETS = 16 << 20, 64
#: Owned windows of a shard and documents of a task, about; windows that one automaton holds at most.
SHARD_WINDOWS, TASK_DOCS, AUTOMATON_WINDOWS = 60_000, 2_000, 120_000
#: Bytes of removed spans up to which they are broadcast to the last pass (16 a span and 48 a document).
SPANS_TO_BROADCAST = 32 << 20
#: Bytes kept of a window's hash within a bucket: with the bucket's bits, all but two of it.
KEY_BYTES = 7


def packed_windows(docs: DataFrame, buckets: int, key_bytes: int = KEY_BYTES) -> DataFrame:
    """(bucket, ids, counts, keys): for each run of texts, the windows' hashes of a bucket in the order of documents.

    Rows of the buckets after the last are done with: they pass on what the run itself has found. From ``buckets`` on, ids
    are pairs of owner and member, and from twice that on, owners with counts of keys and these.
    """
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy()
            for low, high, data, offsets in runs(*text_bytes(batch.column(1)), 2_000_000):
                w = split(data, offsets, SPACED)
                hashes, ids = w.hashes(), every[low:high]
                key, good = windows(hashes, w.first, WINDOW)
                at = np.flatnonzero(good)
                of, key = w.text_of()[at], key[at]
                of, key, pairs = _firsts(ids, of, key, at, hashes)
                bucket = (key >> shift).astype(np.int16 if buckets < 32768 else np.int64)
                order = np.argsort(bucket, kind="stable")
                of, key, bucket = of[order], key[order], bucket[order]
                edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)) if len(bucket) else np.zeros(0, np.int64)
                rows = []
                for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    own, counts = np.unique(of[i:j], return_counts=True)
                    rows.append((int(bucket[i]), ids[own].tobytes(), counts.astype(np.int32).tobytes(), key[i:j].view(np.uint8).reshape(-1, 8)[:, :key_bytes].tobytes()))
                if len(pairs[0]):
                    owner, member, key = pairs
                    place = int(owner[0] % buckets)
                    found = np.unique(np.column_stack([owner, member]), axis=0)
                    rows.append((buckets + place, found.tobytes(), b"", b""))
                    own = np.unique(np.rec.fromarrays([owner, _kept(key, key_bytes)], names="owner,key"))
                    names, counts = np.unique(own.owner, return_counts=True)
                    rows.append((2 * buckets + place, names.tobytes(), counts.astype(np.int32).tobytes(), np.ascontiguousarray(own.key).tobytes()))
                if rows:
                    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["bucket", "ids", "counts", "keys"])

    return spread(docs.select("id", "text")).mapInArrow(run, "bucket int, ids binary, counts binary, keys binary")


def _firsts(ids: np.ndarray, of: np.ndarray, key: np.ndarray, at: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """Windows (text, hash) of a run without those that a text of a smaller id has as well, and these as (owner, member,
    hash). Windows of one hash are told apart by their words; ``at`` is where each begins."""
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[1:] = key[order[1:]] == key[order[:-1]]
    if not again.any():
        return of, key, (np.zeros(0, np.int64),) * 3
    some = again.copy()
    some[:-1] |= again[1:]
    order, again = order[some], again[some]  # windows whose hash is in the run more than once
    start = np.flatnonzero(~again)
    group = np.cumsum(~again) - 1
    doc = ids[of[order]]
    least = np.lexsort((doc, group))[start]  # of each hash, a window in the text of smallest id
    step = np.arange(WINDOW)
    same = (hashes[at[order][:, None] + step] == hashes[at[order[least]][group][:, None] + step]).all(axis=1)
    later = same & (doc > doc[least][group])
    out = np.ones(len(key), bool)
    out[order[later]] = False
    repeated = same & (doc == doc[least][group])
    repeated[least] = False
    out[order[repeated]] = False  # once for each text of smallest id
    return of[out], key[out], (doc[least][group][later], doc[later], key[order[later]])


def _wide(keys: bytes, key_bytes: int) -> np.ndarray:
    """Kept hash bytes as numbers."""
    out = np.zeros((len(keys) // key_bytes, 8), np.uint8)
    out[:, :key_bytes] = np.frombuffer(keys, np.uint8).reshape(-1, key_bytes)
    return out.view(np.uint64).ravel()


def _kept(keys: np.ndarray, key_bytes: int) -> np.ndarray:
    """The kept bytes of full hashes as numbers."""
    return keys & np.uint64((1 << 8 * key_bytes) - 1)


def recurring(packed: DataFrame, buckets: int, key_bytes: int = KEY_BYTES) -> DataFrame:
    """(owner, member, keys): documents that share windows with a smaller one, and the owners' own rows with their keys."""

    def found(owner: np.ndarray, member: np.ndarray, keys: list[bytes | None]) -> pa.Table:
        return pa.table({"owner": pa.array(owner, pa.int64()), "member": pa.array(member, pa.int64()), "keys": pa.array(keys, pa.binary())})

    def group(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        if bucket >= 2 * buckets:
            names = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table["ids"]])
            blobs = []
            for counts, keys in zip(table["counts"], table["keys"], strict=True):
                ends = 8 * np.cumsum(np.frombuffer(counts.as_buffer(), np.int32), dtype=np.int64)
                keys = keys.as_py()
                blobs += [keys[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            return found(names, names, blobs)
        if bucket >= buckets:
            pairs = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table["ids"]]).reshape(-1, 2)
            return found(pairs[:, 0], pairs[:, 1], [None] * len(pairs))
        ids = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table["ids"]])
        of = np.repeat(np.arange(len(ids), dtype=np.int32), np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in table["counts"]]))
        keys = np.concatenate([_wide(x.as_py(), key_bytes) for x in table["keys"]])
        order = np.argsort(keys, kind="stable")
        keys, doc = keys[order], ids[of[order]]
        del order, of
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        if not len(start):
            return found([], [], [])
        low, high = np.minimum.reduceat(doc, start), np.maximum.reduceat(doc, start)
        size = np.diff(np.append(start, len(keys)))
        shared = low < high
        if not shared.any():
            return found([], [], [])
        rows = np.repeat(shared, size)
        pairs = np.column_stack([np.repeat(low[shared], size[shared]), doc[rows]])
        order = np.lexsort((pairs[:, 1], pairs[:, 0]))
        pairs = pairs[order]
        pairs = pairs[np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(axis=1)])] if len(pairs) else pairs
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        owner, key = low[shared], keys[start[shared]]
        order = np.argsort(owner, kind="stable")
        owner, key = owner[order], key[order]
        own, first = np.unique(owner, return_index=True)
        blobs = [key[a:b].tobytes() for a, b in zip(first.tolist(), [*first[1:].tolist(), len(key)], strict=True)]
        return found(np.concatenate([pairs[:, 0], own]), np.concatenate([pairs[:, 1], own]), [None] * len(pairs) + blobs)

    return packed.groupBy("bucket").applyInArrow(group, "owner long, member long, keys binary")


#: Words of a block. Blocks stand at every BLOCK-th word of a passage, so each window of it holds one whole.
BLOCK = (WINDOW + 1) // 2
#: Words of a window besides its block, and places of blocks compared at once.
SIDE, PAIRS = WINDOW - BLOCK, 100_000


class Phrases:
    """An automaton of the blocks of recurring passages, with the owner of each passage."""

    def __init__(self, passages: list[np.ndarray], owners: list[int]):
        """passages: word hashes of stretches all of whose windows recur."""
        import ahocorasick

        sizes = np.array([len(p) for p in passages])
        self.vocabulary, numbers = np.unique(np.concatenate(passages), return_inverse=True)
        # All passages in one line, with room between them for words that equal none.
        start = np.cumsum(sizes + SIDE) - sizes
        self.line = np.full(int(start[-1] + sizes[-1]) + SIDE, -1, np.int32)
        self.line[np.repeat(start - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(numbers))] = numbers + 1
        at: dict[tuple[int, ...], list[int]] = {}
        owner: dict[int, int] = {}
        for p, n, who in zip(start.tolist(), sizes.tolist(), owners, strict=True):
            words = self.line[p : p + n].tolist()
            for m in range(0, n - BLOCK + 1, BLOCK):
                at.setdefault(tuple(words[m : m + BLOCK]), []).append(p + m)
                owner[p + m] = who
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for i, block in enumerate(at):
            self.automaton.add_word(block, i)
        self.automaton.make_automaton()
        self.count = np.array([len(x) for x in at.values()])
        self.first = np.cumsum(self.count) - self.count
        self.places = np.array([x for found in at.values() for x in found])
        self.owners = np.array([owner[x] for x in self.places.tolist()], np.int64)

    def occurrences(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, end, owner) of stretches of a document that lie in a passage and hold a window or more.

        Blocks are found by the automaton; of the words before and behind each, those of the windows that hold it are compared.
        """
        none = (np.zeros(0, np.int64),) * 3
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        words = np.where(self.vocabulary[at] == hashes, at + 1, 0).astype(np.int32)
        # A stretch of fewer known words than a window holds no occurrence; the others stream with a break between them.
        edge = np.flatnonzero(np.diff((words > 0).view(np.int8), prepend=0, append=0))
        start, end = edge[::2], edge[1::2]
        long_ = end - start >= WINDOW
        start, size = start[long_], (end - start)[long_] + 1
        if not len(start):
            return none
        place = np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)
        numbers = words[np.minimum(place, len(words) - 1)]
        numbers[np.cumsum(size) - 1] = 0
        hits = np.array(list(self.automaton.iter(tuple(numbers.tolist()))), np.int64).reshape(-1, 2)
        if not len(hits):
            return none
        low, block = place[hits[:, 0]] - BLOCK + 1, hits[:, 1]
        upto = np.cumsum(self.count[block])
        padded = np.concatenate([np.full(SIDE, -2, np.int32), words, np.full(SIDE, -2, np.int32)])
        step, out = np.arange(SIDE), []
        i = 0
        while i < len(low):  # as many hits at a time as have about PAIRS places
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + PAIRS, "right")))
            n = self.count[block[i:j]]
            entry = np.repeat(self.first[block[i:j]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            here, there = np.repeat(low[i:j], n), self.places[entry]
            before = padded[(here + SIDE - 1)[:, None] - step] == self.line[(there - 1)[:, None] - step]
            behind = padded[(here + SIDE + BLOCK)[:, None] + step] == self.line[(there + BLOCK)[:, None] + step]
            left, right = (np.cumprod(x, axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64) for x in (before, behind))
            good = left + right >= SIDE
            out.append(((here - left)[good], (here + BLOCK + right)[good], self.owners[entry][good]))
            i = j
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def covered(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of n words lie in a span."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, a, 1)
    np.add.at(change, b, -1)
    return np.cumsum(change[:-1]) > 0


SCHEMA = "doc_id long, n_words long, n_removed long, removed array<struct<a:int,b:int>>, kept string"


def repeated_spans(docs: DataFrame, key_bytes: int = KEY_BYTES) -> tuple[DataFrame, DataFrame]:
    """(id, h, spans): word spans of each (id, text) that a document of smaller id has too, in parts to be united; and the
    staged table that they are read from.

    ``h`` is the text's xxhash64, which tells rows of one id apart.
    """
    size = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    buckets = LEAST_BUCKETS
    while buckets * BUCKET_BYTES < size:
        buckets *= 2
    held = staged(recurring(packed_windows(docs, buckets, key_bytes), buckets, key_bytes), "recurring")
    owners = held.filter(F.col("keys").isNotNull())
    members = held.filter(F.col("keys").isNull()).select("owner", "member").distinct()
    owned = int(owners.agg(F.sum(F.length("keys"))).first()[0] or 0) // 8
    shard = F.pmod(F.xxhash64("owner"), F.lit(max(1, -(-owned // SHARD_WINDOWS))))
    routed = staged(members.select(shard.alias("shard"), F.col("member").alias("id")).distinct(), "routes")
    tasks = routed.groupBy("shard").agg(F.ceil(F.count("*") / TASK_DOCS).alias("tasks"))
    streams = routed.join(tasks, "shard").select("shard", F.pmod(F.xxhash64("id"), F.col("tasks")).alias("task"), "id", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("keys"))
    # Keys of an owner stay in the pieces its buckets gave: no more than its windows.
    sources = owners.groupBy("owner").agg(F.collect_list("keys").alias("pieces")).withColumn("shard", shard).join(tasks, "shard")
    sources = sources.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("task"), F.col("owner").alias("id"), F.lit(0).alias("kind"), F.expr("aggregate(pieces, cast('' as binary), (a, x) -> concat(a, x))").alias("keys"))
    dealt = streams.unionByName(sources)
    texts = wanted_texts(docs, routed.select("id").unionByName(owners.select(F.col("owner").alias("id"))), "id", "text")
    # Documents of one id are all read; as owners they are one.
    rows = dealt.join(texts.withColumn("h", F.xxhash64("text")), "id").repartition("shard", "task").sortWithinPartitions("shard", "task", "kind", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["shard", "task"]):
            names = list(zip(table["shard"].to_pylist(), table["task"].to_pylist(), strict=True))
            edges = [i for i in range(len(names)) if not i or names[i] != names[i - 1]] + [len(names)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                yield from _stream(table.slice(a, b - a), key_bytes)

    found = rows.select("shard", "task", "kind", "id", "h", "text", "keys").mapInArrow(run, "id long, h long, spans array<struct<a:int,b:int>>, window binary")
    found = staged(found, "found")
    release(held, routed)
    odd = found.filter(F.col("window").isNotNull())
    first = odd.groupBy("window").agg(F.min("id").alias("owner"))
    later = odd.join(first, "window").filter(F.col("owner") < F.col("id"))
    return found.filter(F.col("window").isNull()).select("id", "h", "spans").unionByName(later.select("id", "h", "spans")), found


def _stream(table: pa.Table, key_bytes: int) -> Iterator[pa.RecordBatch]:
    """All documents of one task through the automata of its owners."""
    kinds, ids = table["kind"].to_numpy(), table["id"].to_numpy()
    sources, docs = table.filter(pa.array(kinds == 0)), table.filter(pa.array(kinds == 1))
    phrases: list[Phrases] = []
    owned = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in sources["keys"]] or [np.zeros(0, np.uint64)]))
    held: list[np.ndarray] = []
    owners: list[int] = []
    names, blobs, count = ids[kinds == 0], sources["keys"], 0
    for low, high, data, offsets in runs(*text_bytes(sources["text"])):
        w = split(data, offsets, SPACED)
        hashes = w.hashes()
        key, good = windows(hashes, w.first, WINDOW)
        for i in range(high - low):
            at = np.arange(w.first[i], w.first[i + 1])
            wanted = np.frombuffer(blobs[low + i].as_buffer(), np.uint64)
            at = _once(at[good[at] & np.isin(_kept(key[at], key_bytes), wanted)], key, hashes)
            for c in range(0, len(at), AUTOMATON_WINDOWS):
                part = at[c : c + AUTOMATON_WINDOWS]
                for run in np.split(part, np.flatnonzero(np.diff(part) > 1) + 1):
                    held.append(hashes[run[0] : run[-1] + WINDOW])
                    owners.append(int(names[low + i]))
                count += len(part)
                if count >= AUTOMATON_WINDOWS:
                    phrases.append(Phrases(held, owners))
                    held, owners, count = [], [], 0
    # Automata are few: the shard's windows are about SHARD_WINDOWS, unless one owner has more.
    if held:
        phrases.append(Phrases(held, owners))
    names, marks = ids[kinds == 1], docs["h"].to_numpy()
    for low, high, data, offsets in runs(*text_bytes(docs["text"])):
        w = split(data, offsets, SPACED)
        hashes, out = w.hashes(), []
        key, good = windows(hashes, w.first, WINDOW)
        key = _kept(key, key_bytes)
        maybe = good & (owned[np.minimum(np.searchsorted(owned, key), len(owned) - 1)] == key) if len(owned) else np.zeros(len(key), bool)
        for i in range(high - low):
            a, b = w.first[i], w.first[i + 1]
            doc, mark = int(names[low + i]), int(marks[low + i])
            n = int(b - a)
            found = [p.occurrences(hashes[a:b]) for p in phrases]
            x, y, owner = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in range(3))
            smaller = owner < doc
            if smaller.any():
                edge = np.flatnonzero(np.diff(covered(n, x[smaller], y[smaller]).view(np.int8), prepend=0, append=0))
                out.append((doc, mark, [{"a": p, "b": q} for p, q in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)], None))
            odd = maybe[a:b] & ~covered(n, x, y - WINDOW + 1)
            for at in np.flatnonzero(odd).tolist():  # a window whose hash is that of another one
                text = b" ".join(bytes(data[x:y]) for x, y in zip(w.starts[a + at : a + at + WINDOW], w.ends[a + at : a + at + WINDOW], strict=True))
                out.append((doc, mark, [{"a": at, "b": at + WINDOW}], text))
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["id", "h", "spans", "window"])


def _once(at: np.ndarray, key: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Of windows that begin at the given words, the first of each kind, in order."""
    _, first, of = np.unique(key[at], return_index=True, return_inverse=True)
    if len(first) == len(at):
        return at
    rows = hashes[at[:, None] + np.arange(WINDOW)]
    if (rows != rows[first][of]).any():  # different windows of one hash
        first = np.unique(rows, axis=0, return_index=True)[1]
    return at[np.sort(first)]


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in runs(*text_bytes(batch.column(1))):
            w = split(data, offsets, SPACED)
            change = np.zeros(len(w.starts) + 1, np.int64)
            spans = batch.column(2).slice(low, high - low)
            lists = spans.flatten()
            if len(lists):
                at = np.repeat(w.first[:-1], np.array([len(x) if x.is_valid else 0 for x in spans]))
                a, b = (lists.field(k).to_numpy() for k in (0, 1))
                np.add.at(change, at + a, 1)
                np.add.at(change, at + b, -1)
            keep = np.cumsum(change[:-1]) == 0
            # Bytes of kept words, and after each but a text's last one space, put where a separator was.
            step = np.zeros(len(data) + 1, np.int8)
            step[w.starts[keep]] += 1
            step[w.ends[keep]] -= 1
            take = np.cumsum(step[:-1], dtype=np.int8) > 0
            of = w.text_of()[keep]
            more = np.append(of[1:] == of[:-1], False) if len(of) else np.zeros(0, bool)
            gaps = w.ends[keep][more]
            data = data.copy()
            data[gaps] = 0x20
            take[gaps] = True
            upto = np.concatenate([[0], np.cumsum(take)])[offsets]
            kept = pa.Array.from_buffers(pa.large_string(), high - low, [None, pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[take]))]).cast(pa.string())
            removed = w.counts - np.bincount(of, minlength=high - low)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(w.counts.astype(np.int64)), pa.array(removed.astype(np.int64)), spans, kept], names=["doc_id", "n_words", "n_removed", "removed", "kept"])


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", key_bytes: int = KEY_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, removed (word spans), kept (words joined by one space).

    A word goes if it lies in a window that also starts in a document of smaller id; windows are those of the input. Null
    texts have no words; of texts of fewer than 13 words nothing goes. Rows of null id neither lose words nor make others
    lose any. Rows that share an id are parts of one document: what one repeats of another stays. Other columns are not
    read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parts, found = repeated_spans(rows.filter(F.col("id").isNotNull() & F.col("text").isNotNull()), key_bytes)
    spans = staged(parts.groupBy("id", "h").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    release(found)
    if (spans.agg(F.sum(48 + 16 * F.size("spans").cast("long"))).first()[0] or 0) <= SPANS_TO_BROADCAST:
        spans = F.broadcast(spans)
    joined = spread(rows).withColumn("h", F.xxhash64("text")).join(spans, ["id", "h"], "left")
    return joined.select("id", "text", "spans").mapInArrow(_cleaned, SCHEMA)
