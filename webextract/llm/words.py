"""Words of many texts at once: numpy over the UTF-8 bytes of an Arrow column.

A word's hash takes eight bytes at a time, each scrambled into the last by a finaliser that is not linear, so no words are
of one hash by their structure, as they would be for a polynomial modulo a power of two. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Texts are worked on in runs of about this many bytes; a longer text forms a run of its own.
RUN_BYTES = 500_000

#: Words of more bytes are hashed one by one.
LONG_WORD = 256

_MASK = (1 << 64) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)
_FIRST_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: a one-to-one scrambling of uint64 values."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Alphabet:
    """Which bytes belong to words, and what each stands for (none: itself)."""

    inside: np.ndarray
    to: np.ndarray | None


def _alphabet(separators: set[int], lower: bool) -> Alphabet:
    inside = np.array([b not in separators for b in range(256)])
    return Alphabet(inside, np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8) if lower else None)


_SPACE = {0x20, *range(0x09, 0x0E)}
#: ``[^\x20\x09-\x0D]+``
SPACED = _alphabet(_SPACE, lower=False)
#: The same after lower-casing A-Z.
SPACED_LOWER = _alphabet(_SPACE, lower=True)
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
ALNUM_LOWER = _alphabet({*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)}, lower=True)

def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes."""
    size = ends - starts
    out = mix(size.astype(np.uint64), seed + 1)
    if not len(starts):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))  # the eight bytes from each place on
    whole = np.arange(len(starts)) if int(size.max()) <= LONG_WORD else np.flatnonzero(size <= LONG_WORD)
    for at in range(0, int(size[whole].max(initial=0)), 8):
        live = whole if at == 0 else whole[size[whole] > at]
        chunk = eight[starts[live] + at] & _FIRST_BYTES[np.minimum(size[live] - at, 8)]
        out[live] = mix(out[live] ^ chunk, seed + 2)
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), seed)
    return out


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each starts (one more at the end)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, at, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(data: np.ndarray, offsets: np.ndarray, most: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end text, bytes, offsets) of consecutive runs of texts."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


@dataclass
class Words:
    """Words of a run of texts, in order."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # of each text, and one more
    plain: np.ndarray  # the bytes that count, so after lower-casing

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return byte_hashes(self.plain, self.starts, self.ends)

    def prefix_hashes(self, length: int) -> np.ndarray:
        """Hashes of the words' first ``length`` bytes."""
        return byte_hashes(self.plain, self.starts, np.minimum(self.ends, self.starts + length), length)

    def text_of(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def split(data: np.ndarray, offsets: np.ndarray, alphabet: Alphabet) -> Words:
    """Words of a run; none spans two texts."""
    inside = alphabet.inside[data]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[edge] = False
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[edge[edge > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets), data if alphabet.to is None else alphabet.to[data])


def windows(hashes: np.ndarray, first: np.ndarray, width: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``width`` words from each word on, and whether they lie in one text.

    With ``short``, a text of fewer words, but not none, has one window: all of them.
    """
    n = len(hashes)
    good = np.arange(n) + width <= np.repeat(first[1:], np.diff(first))
    # Of 1, 2, 4, ... words; two of the last, which may overlap, make up the width.
    out, span = hashes, 1
    while span < width:
        step = min(span, width - span)
        out = mix(out * _ODD + np.concatenate([out[step:], np.zeros(min(step, n), np.uint64)]), width)
        span += step
    if short:
        counts = np.diff(first)
        which = np.flatnonzero((counts > 0) & (counts < width))
        at, counts = first[which], counts[which]
        few = mix(counts.astype(np.uint64), width + 1)
        for k in range(width - 1):
            live = np.flatnonzero(counts > k)
            few[live] = mix(few[live] * _ODD + hashes[at[live] + k], width + 2)
        out = out.copy() if out is hashes else out
        out[at] = few
        good[at] = True
    return out, good
