"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

Features are densities of a fixed and of a learnt lexicon (words and word beginnings), how near their hits are to words of
the second person, and rates of capitals, punctuation and obfuscated words; all from numpy over a run of texts at once.
A bounded sample of labelled rows, chosen by hash, is split in three: one part gives the lexicon, counted by a Spark
aggregation, one the trees, one the calibration. Scoring goes over every text once and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import release, spread, staged
from .words import ALNUM_LOWER, SPACED, Words, runs, split, text_bytes

#: Labelled rows that a model is fitted on, at most about. What is learnt from them, the lexicon too, is bounded by them.
SAMPLE_ROWS = 24_000
#: Lengths of the word beginnings that a lexicon learns; 0 stands for whole words.
PREFIXES = (0, 4, 5, 6)
#: A lexicon entry is in this many toxic texts at least, and so many times likelier in toxic texts.
LEAST_TEXTS, LEAST_LOG_ODDS = 4, 2.0
INSULTS = (
    "idiot", "idiots", "moron", "morons", "stupid", "trash", "pathetic", "loser", "losers", "worthless", "disgusting",
    "scum", "clown", "clowns", "dumb", "filth", "vermin", "garbage", "hate", "kill", "ugly", "freak", "imbecile",
)
SECOND_PERSON = (
    "you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi",
    "ton", "ta", "vous", "votre", "usted", "ustedes", "vos", "ti",
)
NEAR = 5
FEATURES = (
    "log_words", "fixed_count", "fixed_density", "learnt_sum", "learnt_density", "learnt_prefix_sum", "learnt_prefix_density",
    "learnt_max", "near_share", "second_density", "capitals", "capital_words", "exclaims", "questions", "marks", "obfuscated",
    "long_words",
)


def _hashes_of(words: tuple[str, ...]) -> np.ndarray:
    data, offsets = text_bytes(pa.array(words))
    return np.unique(split(data, offsets, ALNUM_LOWER).hashes())


_FIXED, _SECOND = _hashes_of(INSULTS), _hashes_of(SECOND_PERSON)


def _of(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Index of each x in sorted values, or -1."""
    if not len(sorted_values):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return np.where(sorted_values[at] == x, at, -1)


def _keys(w: Words, length: int) -> np.ndarray:
    return w.hashes() if length == 0 else w.prefix_hashes(length)


@dataclass
class Lexicon:
    """Learnt entries: sorted hashes and weights of whole words and of word beginnings."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    lengths: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def weigh(self, w: Words, lengths: tuple[int, ...]) -> np.ndarray:
        """Highest weight of each word."""
        out = np.zeros(len(w.starts))
        for length in lengths:
            own = self.lengths == length
            keys, weights = self.keys[own], self.weights[own]
            if len(keys):
                at = _of(keys, _keys(w, length))
                out = np.maximum(out, np.where(at >= 0, weights[at], 0.0))
        return out


def features(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """[text, feature] of a run of texts."""
    n = len(offsets) - 1
    w = split(data, offsets, ALNUM_LOWER)
    of, counts = w.text_of(), w.counts
    per = np.maximum(counts, 1)
    by_text = lambda x, of=of: np.bincount(of, x, n)
    fixed = _of(_FIXED, w.hashes()) >= 0
    second = _of(_SECOND, w.hashes()) >= 0
    learnt, begun = lexicon.weigh(w, (0,)), lexicon.weigh(w, PREFIXES[1:])
    hits = np.flatnonzero(fixed | (learnt > 0) | (begun > 0))
    people = np.flatnonzero(second)
    near = np.zeros(len(hits))
    if len(people) and len(hits):
        for step in (-1, 0):
            p = people[np.clip(np.searchsorted(people, hits) + step, 0, len(people) - 1)]
            near = np.maximum(near, (np.abs(p - hits) <= NEAR) & (of[p] == of[hits]))
    most = np.zeros(n)
    np.maximum.at(most, of[hits], np.maximum(learnt, begun)[hits])
    sizes = np.maximum(np.diff(offsets), 1)

    def rate(inside: np.ndarray) -> np.ndarray:
        total = np.zeros(len(inside) + 1, np.int64)
        np.cumsum(inside, out=total[1:])
        return np.diff(total[offsets]) / sizes

    capital = (data >= 65) & (data <= 90)
    letter = capital | ((data >= 97) & (data <= 122)) | (data >= 128)
    digit = (data >= 48) & (data <= 57)
    symbol = np.isin(data, list(b"#$%&*@"))
    s = split(data, offsets, SPACED)
    at = lambda x: np.concatenate([[0], np.cumsum(x)])
    within = lambda total: total[s.ends] - total[s.starts]
    letters, odd, capitals = within(at(letter)), within(at(digit | symbol)), within(at(capital))
    s_of = s.text_of()
    s_per = np.maximum(s.counts, 1)
    length = s.ends - s.starts
    return np.column_stack([
        np.log1p(counts), np.log1p(by_text(fixed)), by_text(fixed) / per, np.log1p(by_text(learnt)), by_text(learnt > 0) / per,
        np.log1p(by_text(begun)), by_text(begun > 0) / per, most,
        np.bincount(of[hits], near, n) / np.maximum(np.bincount(of[hits], minlength=n), 1), by_text(second) / per,
        rate(capital), np.bincount(s_of, (capitals == letters) & (letters > 1), n) / s_per, rate(data == 33), rate(data == 63),
        rate(symbol | np.isin(data, list(b";:.,-_"))), np.bincount(s_of, (letters > 0) & (odd > 0), n) / s_per,
        np.bincount(s_of, length > 20, n) / s_per,
    ])


@dataclass
class Trees:
    """Boosted trees of one depth over binned features, for the log odds of a label."""

    edges: list[np.ndarray]
    start: float
    splits: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # feature and bin of each inner node, value of each leaf

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 2.0, ridge: float = 1.0) -> Trees:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        mean = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
        out = Trees(edges, float(np.log(mean / (1 - mean))), [])
        binned = out._bin(x)
        margin = np.full(len(y), out.start)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, np.maximum(p * (1 - p), 1e-9)
            node = np.zeros(len(y), np.int64)
            feature, at = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, bins, np.int64)
            for level in range(depth):
                first, width = (1 << level) - 1, 1 << level
                best = np.full(width, 1e-9)
                for j in range(x.shape[1]):
                    k = node * bins + binned[:, j]
                    gs, hs = (np.bincount(k, v, width * bins).reshape(width, bins) for v in (g, h))
                    gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                    gt, ht = gs.sum(1)[:, None], hs.sum(1)[:, None]
                    gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                    gain = np.where((hl >= least) & (ht - hl >= least), gain, 0)
                    top = gain.argmax(1)
                    better = gain[np.arange(width), top] > best
                    best = np.where(better, gain[np.arange(width), top], best)
                    feature[first : first + width] = np.where(better, j, feature[first : first + width])
                    at[first : first + width] = np.where(better, top, at[first : first + width])
                node = node * 2 + (binned[np.arange(len(y)), feature[first + node]] > at[first + node])
            value = rate * np.bincount(node, g, 1 << depth) / (np.bincount(node, h, 1 << depth) + ridge)
            out.splits.append((feature, at, value))
            margin += value[node]
        return out

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)])

    def margins(self, x: np.ndarray) -> np.ndarray:
        binned, total, rows = self._bin(x), np.full(len(x), self.start), np.arange(len(x))
        for feature, at, value in self.splits:
            node, first = np.zeros(len(x), np.int64), 0
            while first < len(feature):
                node, first = node * 2 + (binned[rows, feature[first + node]] > at[first + node]), first * 2 + 1
            total += value[node]
        return total


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising function nearest to the labels, by pooling neighbours that fall."""
    order = np.argsort(margin, kind="stable")
    levels: list[list[float]] = []  # mean, weight, lowest and highest margin
    for m, v in zip(margin[order].tolist(), y[order].tolist(), strict=True):
        if levels and levels[-1][3] == m:
            last = levels[-1]
            levels[-1] = [(last[0] * last[1] + v) / (last[1] + 1), last[1] + 1, last[2], m]
        else:
            levels.append([v, 1.0, m, m])
        while len(levels) > 1 and levels[-2][0] >= levels[-1][0]:
            b, a = levels.pop(), levels.pop()
            levels.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2], b[3]])
    return np.array([e for lv in levels for e in (lv[2], lv[3])]), np.array([lv[0] for lv in levels for _ in (0, 1)])


#: Calibration rows below which rows of the trees' part are used as well, out of fold.
FEW_ROWS = 200


@dataclass
class Model:
    """Lexicon, trees and calibration; without trees every score is ``rate``."""

    lexicon: Lexicon
    trees: Trees | None = None
    knots: np.ndarray | None = None
    levels: np.ndarray | None = None
    rate: float = 0.0

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if self.trees is None:
            return np.full(n, self.rate)
        margin = self.trees.margins(features(data, offsets, self.lexicon))
        if self.knots is None:
            return 1 / (1 + np.exp(-margin))
        return np.clip(np.interp(margin, self.knots, self.levels) * 0.999 + 0.001 / (1 + np.exp(-margin)), 0, 1)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text, toxic and part (0 lexicon, 1 trees, 2 calibration) of about ``rows`` labelled documents at most, by hash; none
    of the held-out fifth."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), "toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, rows / max(1, known.count()))
    key = lambda seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000))
    part = F.when(key(2) < 400_000, 0).when(key(2) < 800_000, 1).otherwise(2)
    chosen = known.filter(key(1) < F.lit(int(share * 1_000_000))).select("doc_id", "toxic", part.alias("part"))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic", "part")


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Words and beginnings far likelier in toxic texts; texts are counted once for each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in runs(*text_bytes(batch.column(0))):
                w = split(data, offsets, ALNUM_LOWER)
                of, y = w.text_of(), toxic[a:b]
                for length in PREFIXES:
                    pairs = np.unique(np.column_stack([_keys(w, length).view(np.int64), of]), axis=0) if len(of) else np.zeros((0, 2), np.int64)
                    keys, inverse = np.unique(pairs[:, 0], return_inverse=True)
                    bad = np.bincount(inverse, y[pairs[:, 1]] == 1, len(keys)).astype(np.int64)
                    every = np.bincount(inverse, minlength=len(keys)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), length)), pa.array(bad), pa.array(every - bad)], names=["key", "length", "bad", "good"])

    counts = spread(sample.filter("part = 0")).select("text", F.col("toxic").cast("int")).mapInArrow(count, "key long, length long, bad long, good long")
    n = sample.filter("part = 0").agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") != 1)).first()
    odds = F.log((F.col("bad") + 0.5) / F.lit(n[0] + 1.0)) - F.log((F.col("good") + 0.5) / F.lit(n[1] + 1.0))
    best = (
        counts.groupBy("key", "length").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .filter(F.col("bad") >= LEAST_TEXTS).withColumn("odds", odds).filter(F.col("odds") >= LEAST_LOG_ODDS)
        .select("key", "length", "odds").collect()
    )
    keys = np.array([r["key"] for r in best], np.int64).view(np.uint64)
    order = np.lexsort((np.array([r["length"] for r in best], np.int64), keys))
    return Lexicon(keys[order], np.array([r["odds"] for r in best])[order], np.array([r["length"] for r in best], np.int64)[order])


def _apply(batches: Iterator[pa.RecordBatch], column: int, f) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for a, b, data, offsets in runs(*text_bytes(batch.column(column))):
            yield batch.slice(a, b - a), f(data, offsets)


def fit(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from a bounded sample of labelled rows outside the held-out fifth.

    Labels of null id or value are left out; of repeated ones the highest counts. Null texts count as empty, very long ones
    are taken whole, rows that repeat an id each count. With no labels, no documents, or only one kind of label, the model
    gives the label's rate. Other columns are not read. Scores are calibrated on the third part of the sample; where that has fewer than FEW_ROWS
    rows, also on the second part, by trees of the other four fifths of it. Only where these rows are of one kind are scores
    not calibrated.
    """
    sample = staged(labelled_sample(docs, labels, sample_rows, id_col, text_col), "sample")
    rows = spread(sample)
    lexicon = learn_lexicon(sample)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _apply(batches, 0, lambda d, o: features(d, o, lexicon)):
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), part.column(1), part.column(2)], names=["x", "toxic", "part"])

    rows = rows.filter("part > 0").select("text", F.col("toxic").cast("int"), "part").mapInArrow(extract, "x array<double>, toxic int, part int").collect()
    release(sample)
    rows.sort(key=lambda r: (r["part"], r["toxic"], r["x"]))
    x, y, part = np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES)), np.array([r["toxic"] == 1 for r in rows], float), np.array([r["part"] for r in rows])
    if not len(y) or y[part == 1].size == 0 or y[part == 1].min() == y[part == 1].max():
        return Model(lexicon, rate=float(y.mean()) if len(y) else 0.0)
    trees = Trees.fit(x[part == 1], y[part == 1])
    model = Model(lexicon, trees)
    margins, known = trees.margins(x[part == 2]), y[part == 2]
    if len(known) < FEW_ROWS:
        own, kind = x[part == 1], y[part == 1]
        fold = np.arange(len(kind)) % 5  # rows are sorted by label, so folds have their share of both
        for i in range(5):
            if len(set(kind[fold != i].tolist())) == 2:
                margins = np.append(margins, Trees.fit(own[fold != i], kind[fold != i]).margins(own[fold == i]))
                known = np.append(known, kind[fold == i])
    if len(known) and known.min() < known.max():
        model.knots, model.levels = isotonic(margins, known)
    return model


def scored(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted. Null texts count as empty; both get a score.

    Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, score in _apply(batches, 1, model.scores):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    return spread(rows).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs``, all columns of any name, without the rows that score ``threshold`` or more.

    Each row is judged by its own whole text, so repeated rows stay or go together; null texts count as empty. No rows give
    none.
    """
    column = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, score in _apply(batches, column, model.scores):
            yield part.filter(pa.array(score < threshold))

    return spread(docs).mapInArrow(run, docs.schema)
