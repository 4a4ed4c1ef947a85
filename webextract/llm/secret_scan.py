r"""Secrets in texts, also under nested encodings.

A worklist of layers starts with the text. Each layer is scanned, and what it unwraps to is added to the list: the layer
with its percent escapes or its \u, \x and &#; escapes decoded, and the text in each base64 run, through zlib or gzip
where its bytes are compressed. A run that is no text as a whole, and runs joined over single line breaks, are decoded in
all four alignments, and every readable stretch and compressed value in them is taken. Every layer keeps, for each of its characters, the span of the original text it came from,
so finds are given as spans of that text. A layer that was there before, by text and place, is not taken again, so the
list comes to an end.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .words import runs, text_bytes

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of [0-9a-f]+ of 16 and more
LEAST_VALUE, LEAST_ACCESS = 12, 18
WORDS = ("passw", "secret", "token", "api")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPES = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+")
ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:\r?\n[A-Za-z0-9+/_-]++)++={0,2}")
#: In decoded bytes: stretches of UTF-8 that can hold a find, the shortest of which has 16 characters; heads of gzip and zlib.
READABLE = re.compile(
    rb"(?:[\t\n\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}){16,}+"
)
PACKED = re.compile(b"(?=\x1f\x8b\x08|" + b"|".join(re.escape(bytes([a, b])) for a in range(8, 128, 16) for b in range(256) if (a << 8 | b) % 31 == 0 and not b & 32) + b")")
GZIP = b"\x1f\x8b\x08"
#: Bytes of a compressed value that are held at once; larger values are read in windows of WINDOW new bytes. Windows overlap by
#: OVERLAP, or by the run of encoded characters at the border, up to MOST_INFLATED.
MOST_INFLATED, WINDOW, OVERLAP = 16 << 20, 4 << 20, 1 << 16
ENCODED = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=%&#;\\\r\n"

Span = tuple[int, int]
Finds = set[tuple[int, int, int]]  # start, kind, end


def base_finds(text: str) -> Finds:
    """Finds of one layer, in its own positions."""
    out: Finds = set()
    low = text.lower()
    if any(w in low for w in WORDS):
        out |= {(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE}
    if "AKIA" in text:
        out |= {(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS}
    out |= {(m.start(), 2, m.end()) for m in HEX.finditer(text)}
    return out


class Layer:
    """A text whose character i stands for start[i]:end[i] of the original."""

    def __init__(self, text: str, start: np.ndarray, end: np.ndarray):
        self.text, self.start, self.end = text, start, end

    def key(self) -> tuple:
        return (sha256(self.text.encode("utf-8", "surrogatepass")).digest(), int(self.start[0]), int(self.end[-1])) if self.text else ()


def _readable(raw: bytes) -> str | None:
    """The text of bytes that are UTF-8 and nearly all printable."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    good = sum(c.isprintable() or c in "\t\n\r" for c in text)
    return text if text and good >= 0.9 * len(text) else None


def _char_bytes(text: str) -> np.ndarray:
    """Where each character's bytes start in UTF-8, and one more."""
    return np.concatenate([[0], np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in text])]).astype(np.int64)


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with each match of ``pattern`` decoded to [(character, start, end)], or None if nothing is."""
    parts, starts, ends, at = [], [], [], 0
    for m in pattern.finditer(layer.text):
        got = decode(m[0])
        if got is None:
            continue
        a = m.start()
        parts += [layer.text[at:a], "".join(c for c, _, _ in got)]
        starts += [layer.start[at:a], layer.start[[a + s for _, s, _ in got]]]
        ends += [layer.end[at:a], layer.end[[a + e - 1 for _, _, e in got]]]
        at = m.end()
    if not parts:
        return None
    parts.append(layer.text[at:])
    return Layer("".join(parts), np.concatenate([*starts, layer.start[at:]]), np.concatenate([*ends, layer.end[at:]]))


def _percent(s: str) -> list[tuple[str, int, int]] | None:
    try:
        text = bytes.fromhex(s.replace("%", "")).decode()
    except UnicodeDecodeError:
        return None
    b = _char_bytes(text)
    return [(c, 3 * int(b[i]), 3 * int(b[i + 1])) for i, c in enumerate(text)]


def _escapes(s: str) -> list[tuple[str, int, int]] | None:
    out: list[tuple[str, int, int]] = []
    for m in ESCAPE.finditer(s):
        code = int(m[1] or m[2] or m[4] or "0", 16) if m[3] is None else int(m[3])
        if code > 0x10FFFF:
            return None
        if out and 0xDC00 <= code < 0xE000 and 0xD800 <= ord(out[-1][0]) < 0xDC00:
            pair = 0x10000 + ((ord(out[-1][0]) - 0xD800) << 10) + (code - 0xDC00)
            out[-1] = (chr(pair), out[-1][1], m.end())
        else:
            out.append((chr(code), m.start(), m.end()))
    return [("�" if 0xD800 <= ord(c) < 0xE000 else c, a, b) for c, a, b in out]


class _Inflated:
    """What compressed pieces hold, in pieces of a bounded size: a zlib value, or gzip members, which are one value."""

    def __init__(self, packed: Iterator[bytes]):
        self.packed = packed
        self.left: int | None = None  # bytes of the last piece after the last whole value; None where there is no whole one

    def __iter__(self) -> Iterator[bytes]:
        d, rest = zlib.decompressobj(47), b""
        for more in self.packed:
            more, rest, full = rest + more if rest else more, b"", False
            while len(more) or full:
                if d is None:
                    if len(more) < len(GZIP) and GZIP.startswith(more):
                        rest = more
                        break
                    if not more.startswith(GZIP):
                        return
                    d = zlib.decompressobj(31)
                try:
                    out = d.decompress(more, 1 << 20)
                except zlib.error:
                    return
                if out:
                    yield out
                if d.eof:
                    more, d, full = d.unused_data, None, False
                    self.left = len(more)
                else:
                    more, full = d.unconsumed_tail, len(out) == 1 << 20


def _inflated(packed: Iterator[bytes]) -> tuple[bytes | None, bytes, int] | None:
    """What compressed pieces hold, unless it is more than MOST_INFLATED, its digest, and how many bytes are left of the last
    piece; None where the pieces do not begin with a whole compressed value."""
    pieces, kept, n, digest = _Inflated(packed), [], 0, sha256()
    for out in pieces:
        n += len(out)
        digest.update(out)
        if n <= MOST_INFLATED:
            kept.append(out)
        else:
            kept.clear()
    return None if pieces.left is None else (b"".join(kept) if n <= MOST_INFLATED else None, digest.digest(), pieces.left)


def _unpacked(raw: bytes) -> tuple[Iterator[str], int] | None:
    """The texts in compressed bytes, through further compression, and how many of the bytes that took."""
    make, whole, used, seen = lambda: iter((raw,)), None, 0, set()
    while (got := _inflated(make())) is not None:
        whole = got[0]
        used = used or len(raw) - got[2]
        if whole is not None:
            make = lambda x=whole: iter((x,))
        else:
            make = lambda f=make: iter(_Inflated(f()))
        if got[1] in seen:
            break
        seen.add(got[1])
    if not used:
        return None
    if whole is None:
        return _windows(make()), used
    return iter((whole.decode("utf-8", "replace"),)), used


def _windows(pieces: Iterator[bytes]) -> Iterator[str]:
    """A long value as texts that overlap."""
    held, fresh = bytearray(), 0
    for x in pieces:
        held += x
        fresh += len(x)
        if fresh >= WINDOW:
            yield held.decode("utf-8", "replace")
            del held[: max(0, len(held) - MOST_INFLATED, min(len(held) - OVERLAP, len(held.rstrip(ENCODED))))]
            fresh = 0
    if fresh:
        yield held.decode("utf-8", "replace")


def _decoded(body: str) -> bytes:
    """The bytes of base64 characters, without the last one where it is one too many."""
    body = body[: len(body) - (len(body) % 4 == 1)].replace("-", "+").replace("_", "/")
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _all_at(text: str, start: int, end: int) -> Layer:
    """A layer all of whose characters stand for one span."""
    return Layer(text, np.broadcast_to(np.int64(start), len(text)), np.broadcast_to(np.int64(end), len(text)))


def _readings(layer: Layer, body: str, at: np.ndarray) -> Iterator[Layer]:
    """What base64 characters, at the places ``at``, hold anywhere: in each alignment, the readable stretches and what inflates."""
    for skip in range(4):
        raw, place, upto = _decoded(body[skip:]), at[skip:], 0
        for m in READABLE.finditer(raw):
            text = m[0].decode()
            b = m.start() + _char_bytes(text)
            yield Layer(text, layer.start[place[b[:-1] * 8 // 6]], layer.end[place[(b[1:] * 8 - 1) // 6]])
        for m in PACKED.finditer(raw):
            if (a := m.start()) < upto or (got := _unpacked(memoryview(raw)[a:])) is None:
                continue
            upto = a + got[1]
            for text in got[0]:
                yield _all_at(text, layer.start[place[a * 8 // 6]], layer.end[place[(upto * 8 - 1) // 6]])


def _base64(layer: Layer) -> Iterator[Layer]:
    """Runs as wholes; those that are not text as wholes, and runs joined over single line breaks, in every reading."""
    for m in BASE64.finditer(layer.text):
        body, a = m[0].rstrip("="), m.start()
        raw = _decoded(body) if len(body) % 4 != 1 else b""
        packed = _unpacked(raw)
        if packed is not None:
            for text in packed[0]:
                yield _all_at(text, layer.start[a], layer.end[m.end() - 1])
        elif (text := _readable(raw)) is not None:  # byte i lies in the characters from 8i // 6 on
            b = _char_bytes(text)
            yield Layer(text, layer.start[a + b[:-1] * 8 // 6], layer.end[a + (b[1:] * 8 - 1) // 6])
            continue
        if packed is None or packed[1] < len(raw):
            yield from _readings(layer, body, np.arange(a, a + len(body)))
    for m in WRAPPED.finditer(layer.text):
        body = m[0].rstrip("=")
        at = np.array([i for i, c in enumerate(body, m.start()) if c not in "\r\n"])
        if len(at) >= 16:
            yield from _readings(layer, body.replace("\r", "").replace("\n", ""), at)


def all_finds(text: str) -> tuple[Finds, Finds]:
    """(base finds, finds of all layers), both in the text's positions."""
    base = base_finds(text)
    return base, base | inner_finds(text)


def inner_finds(text: str) -> Finds:
    """Finds of the layers under the text."""
    n = len(text)
    work, seen, out = [iter((Layer(text, np.arange(n), np.arange(1, n + 1)),))], set(), set()
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if not layer.text or (key := layer.key()) in seen:
            continue
        if seen:
            out |= {(int(layer.start[a]), k, int(layer.end[b - 1])) for a, k, b in base_finds(layer.text)}
        seen.add(key)
        work.append(_under(layer))
    return out


def _under(layer: Layer) -> Iterator[Layer]:
    """The layers that one unwraps to."""
    for pattern, decode in ((PERCENT, _percent), (ESCAPES, _escapes)):
        if (more := _replaced(layer, pattern, decode)) is not None:
            yield more
    yield from _base64(layer)


_HEX = np.isin(np.arange(256), list(b"0123456789abcdef"))
_B64 = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"))
_WRAPPED = _B64 | np.isin(np.arange(256), list(b"\r\n"))


def _has_run(inside: np.ndarray, offsets: np.ndarray, least: int) -> np.ndarray:
    """Texts with a run of ``least`` bytes of a class (a run over the border of two texts may count for either)."""
    edge = np.diff(inside.view(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long_ = end - start >= least
    out = np.zeros(len(offsets) - 1, bool)
    if len(out):
        a = np.clip(np.searchsorted(offsets, start[long_], "right") - 1, 0, len(out) - 1)
        b = np.clip(np.searchsorted(offsets, end[long_] - 1, "right") - 1, 0, len(out) - 1)
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            out[x : y + 1] = True
    return out


def joined(finds: Finds) -> str:
    """kind:start:end of the finds, by start, then kind, then end."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(finds))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string"


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, counts of base finds by kind, base and all spans as ``kind:start:end``.

    Spans are in code points, end exclusive. Null and empty texts have no finds. Rows are independent, so repeated rows
    give repeated results; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in runs(*text_bytes(batch.column(1))):
                lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8).tobytes()
                raw = data.tobytes()
                some = _has_run(_HEX[data], offsets, 16)
                deep = _has_run(_B64[data], offsets, 16) | _has_run(_WRAPPED[data], offsets, 17)
                signs = [(x.encode(), lower, some) for x in WORDS] + [(b"AKIA", raw, some)] + [(x, raw, deep) for x in (b"%", b"\\u", b"\\x", b"&#")]
                for w, where, flag in signs:
                    at = where.find(w)
                    while at >= 0:  # to the next text, once one has it
                        i = int(np.searchsorted(offsets, at, "right")) - 1
                        flag[i] = True
                        at = where.find(w, int(offsets[i + 1]))
                rows = []
                for i in range(high - low):
                    base: Finds = set()
                    every: Finds = set()
                    if some[i] or deep[i]:
                        text = raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace")
                        base = base_finds(text) if some[i] else set()
                        every = base | inner_finds(text) if deep[i] else base
                    kinds = [k for _, k, _ in base]
                    rows.append((kinds.count(0), kinds.count(1), kinds.count(2), joined(base), joined(every)))
                types = [pa.int64()] * 3 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names=["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"])

    return spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(run, SCHEMA)
