r"""Whole texts to token ids, encoding each distinct piece of text once.

A byte-level pre-tokenizer of the usual pattern never puts a non-space and the white space after it into one piece, so a
text may be cut before such white space and the parts encoded by themselves with the same result. Parts recur; their ids
are kept in sorted arrays by a 64-bit hash, and only parts not seen before go through the tokenizer. Parts of one hash that
differ in length or in a second hash are noticed, and their run of texts is encoded plainly. Cuts are made where they are
certain: before a space, tab or line break that follows printable ASCII or a two-byte character above U+00BF, and between an
ASCII letter and ASCII punctuation, unless a special token has such a place.
"""

from __future__ import annotations

import numpy as np

from .words import byte_hashes

#: Parts kept by a worker; beyond it those met least often go. An entry takes about 60 bytes.
MEMO_PARTS = 600_000
#: New parts that are encoded as one text.
JOINED_PARTS = 2_000
_SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0D])
_PRINT = (np.arange(256) > 0x20) & (np.arange(256) < 0x7F)
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
_PUNCTUATION = _PRINT & ~_LETTER & ~np.isin(np.arange(256), [*range(48, 58)])
_TAIL = np.arange(256) >= 0x80
_LEAD = (np.arange(256) >= 0xC3) & (np.arange(256) <= 0xDF)


class PartEncoder:
    """Encodes runs of texts given as UTF-8 bytes and offsets."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.token_bytes = self._token_bytes()
        self.marks_start = _PUNCTUATION.copy()
        for token in tokenizer.get_added_tokens_decoder().values():
            b = np.frombuffer(token.content.encode(), np.uint8)
            self.marks_start[b[1:][_LETTER[b[:-1]]]] = False
        self.clear()

    def clear(self) -> None:
        self.keys, self.marks, self.at, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.hits = np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0

    def _token_bytes(self) -> np.ndarray:
        """Bytes that each id stands for."""
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        out = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            out[i] = len(token)  # in a byte-level vocabulary, a character for each byte
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            out[i] = len(token.content.encode())
        return out

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def _encode_parts(self, parts: list[bytes], joinable: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts, one after the other, and how many each has.

        Parts that begin and end at certain cuts are encoded many at a time as one text, those of punctuation behind a
        letter; the bytes of the ids tell where a part ends.
        """
        ids: list[np.ndarray] = [np.zeros(0, np.int32)] * len(parts)
        which = np.flatnonzero(joinable).tolist()
        for low in range(0, len(which), JOINED_PARTS):
            own = which[low : low + JOINED_PARTS]
            pieces = [x for i in own for x in ((b" x", parts[i]) if self.marks_start[parts[i][0]] else (parts[i],))]
            got = self._ids(b"".join(pieces).decode())
            upto = np.concatenate([[0], np.cumsum(self.token_bytes[got])])
            ends = np.cumsum([len(x) for x in pieces])
            at = np.searchsorted(upto, ends)
            if upto[-1] == ends[-1] and (upto[at] == ends).all():
                last = np.cumsum([2 if self.marks_start[parts[i][0]] else 1 for i in own]) - 1
                for i, a, b in zip(own, np.where(last > 0, at[last - 1], 0).tolist(), at[last].tolist(), strict=True):
                    ids[i] = got[a:b]
            else:  # not a byte-level vocabulary
                joinable[own] = False
        for i in np.flatnonzero(~joinable).tolist():
            ids[i] = self._ids(parts[i].decode())
        return np.concatenate(ids), np.array([len(x) for x in ids], np.int64)

    def _learn(self, keys: np.ndarray, marks: np.ndarray, parts: list[bytes], joinable: np.ndarray) -> None:
        if len(self.keys) + len(keys) > MEMO_PARTS:
            raise OverflowError
        flat, sizes = self._encode_parts(parts, joinable)
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(flat), self.used), np.int32)])
        self.pool[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        where = np.searchsorted(self.keys, keys)
        self.keys, self.marks = np.insert(self.keys, where, keys), np.insert(self.marks, where, marks)
        self.at, self.sizes, self.hits = np.insert(self.at, where, at), np.insert(self.sizes, where, sizes), np.insert(self.hits, where, 0)

    def _forget(self, room: int) -> None:
        """Make room for new parts: at most half of the store stays, the parts met most often, and counts are halved."""
        most = min(MEMO_PARTS // 2, MEMO_PARTS - room)
        keep = np.sort(np.argsort(-self.hits, kind="stable")[:most])
        sizes, old = self.sizes[keep], self.at[keep]
        after = np.cumsum(sizes)
        total = int(after[-1]) if len(after) else 0
        self.pool = self.pool[np.repeat(old - (after - sizes), sizes) + np.arange(total)]
        self.keys, self.marks, self.hits = self.keys[keep], self.marks[keep], self.hits[keep] // 2
        self.at, self.sizes, self.used = after - sizes, sizes, total

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each text has."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        cut = np.zeros(n, bool)
        cut[1:] = _SPACE[data[1:]] & _PRINT[data[:-1]]
        cut[2:] |= _SPACE[data[2:]] & _TAIL[data[1:-1]] & _LEAD[data[:-2]]
        cut[1:] |= self.marks_start[data[1:]] & _LETTER[data[:-1]]
        cut[offsets[:-1][offsets[:-1] < n]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        keys, first, of = np.unique(byte_hashes(data, starts, ends, 3), return_index=True, return_inverse=True)
        every = self._marks(data, starts, ends)
        marks = every[first]
        if (marks[of] != every).any():
            return self._plainly(data, offsets)
        for again in (False, True):
            at = np.searchsorted(self.keys, keys)
            new = np.ones(len(keys), bool)
            if len(self.keys):
                near = np.minimum(at, len(self.keys) - 1)
                new = self.keys[near] != keys
                if (self.marks[near] != marks)[~new].any():
                    return self._plainly(data, offsets)
            if not new.any():
                break
            raw, low, high = data.tobytes(), starts[first[new]], ends[first[new]]
            parts = [raw[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]
            joinable = (_SPACE[data[low]] | self.marks_start[data[low]]) & (_PRINT[data[high - 1]] | (_TAIL[data[high - 1]] & _LEAD[data[np.maximum(high - 2, 0)]]) & (high - low > 1))
            try:
                self._learn(keys[new], marks[new], parts, joinable)
            except OverflowError:
                if again or len(keys) > MEMO_PARTS:
                    return self._plainly(data, offsets)
                self._forget(len(keys))
                continue
            at = np.searchsorted(self.keys, keys)
            break
        else:
            return self._plainly(data, offsets)
        self.hits[at] += np.bincount(of, minlength=len(at))
        begin, size = self.at[at][of], self.sizes[at][of]
        after = np.cumsum(size)
        ids = self.pool[np.repeat(begin - (after - size), size) + np.arange(int(after[-1]))]
        upto = np.concatenate([[0], after])
        return ids, np.diff(upto[np.searchsorted(starts, offsets)])

    @staticmethod
    def _marks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tell parts of one hash apart: another hash, and the length in its low bits."""
        return (byte_hashes(data, starts, ends, 17) << np.uint64(16)) | (ends - starts).astype(np.uint64) & np.uint64(0xFFFF)

    def _plainly(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.tokenizer.encode(bytes(data[a:b]).decode(), add_special_tokens=False).ids for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return np.array([i for x in ids for i in x], np.int32), np.array([len(x) for x in ids], np.int64)
