r"""Conversations as training text, with a loss mask over its tokens.

A turn is ``<|turn|>`` role ``<|text|>`` text ``<|end|>``. In roles and texts a backslash is written as ``\\`` and
``<|`` as ``<\|``, so no control string can come from a text and reading back is exact: a backslash stands for the
character after it. The control strings are special tokens, so no token lies across a border of a turn's text.

The whole conversation is encoded once, with offsets, which follow from the bytes that each token stands for. The spans of
its assistant texts and those of the tokens are both in order, so the tokens under a span are found by two binary searches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import PartEncoder
from .token_tables import load_tokenizer
from .words import runs, text_bytes

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
SCHEMA = "conv_id long, formatted string, ids array<int>, token_starts array<int>, token_ends array<int>, loss array<boolean>"
_TURN = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.S)


def escape(text: str) -> str:
    """``text`` without control strings."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    """The text that ``escape`` was given."""
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The conversation's text, and the spans of the texts to learn, in order."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = TURN + escape(role) + TEXT, escape(text)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def token_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens, in order, meet one of the spans, in order."""
    mask = np.zeros(len(starts), bool)
    for a, b in spans:
        if a < b:
            mask[np.searchsorted(ends, a, "right") : np.searchsorted(starts, b, "left")] = True
    return mask


def masked_text(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> str:
    """All text under the mask, unescaped; tokens that share a character give it once."""
    out, upto = [], -1
    a, b = starts[mask], ends[mask]
    i = 0
    while i < len(a):
        low, high = max(int(a[i]), upto), int(b[i])
        i += 1
        while i < len(a) and a[i] <= high:
            high = max(high, int(b[i]))
            i += 1
        out.append(unescape(formatted[low:high]))
        upto = high
    return "".join(out)


def chat_tokenizer(path: str):
    """The tokenizer with the control strings as special tokens and offsets that keep white space."""
    from tokenizers import processors

    t = load_tokenizer(path)
    t.add_special_tokens([TURN, TEXT, END])
    t.post_processor = processors.ByteLevel(trim_offsets=False)
    return t


_encoders: dict[str, PartEncoder] = {}


def chat_encoder(path: str) -> PartEncoder:
    """This worker's encoder of rendered conversations."""
    if path not in _encoders:
        _encoders[path] = PartEncoder(chat_tokenizer(path))
    return _encoders[path]


def encoded(encoder: PartEncoder, data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, start, end) of the tokens of each text, in characters; a token that is part of a character has that one."""
    ids, sizes = encoder.encode(data, offsets)
    upto = np.concatenate([[0], np.cumsum(encoder.token_bytes[ids])])
    first = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    if (upto[first] == offsets).all():
        characters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # that begin before each byte
        start, end = characters[upto[:-1] + 1] - 1, characters[upto[1:]]
        for i in range(len(sizes)):
            own, base = slice(first[i], first[i + 1]), characters[offsets[i]]
            out.append((ids[own], (start[own] - base).astype(np.int32), (end[own] - base).astype(np.int32)))
        return out
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):  # not a byte-level vocabulary
        code = encoder.tokenizer.encode(bytes(data[a:b]).decode(), add_special_tokens=False)
        at = np.array(code.offsets, np.int32).reshape(-1, 2)
        out.append((np.array(code.ids, np.int32), at[:, 0], at[:, 1]))
    return out


def format_conversations(turns: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per conv_id of ``turns`` (conv_id, turn, role, text): its text, token ids, their offsets and loss mask.

    Rows are in the order of turn, null first, then role and text. Null roles and texts are empty; rows of null conv_id
    are one conversation. Repeated rows are repeated turns. A conversation is one text, encoded whole, so its turns meet in
    one task; different conversations are independent. Other columns are not read.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    whole = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(
        F.sort_array(F.collect_list(F.struct("turn", text("role"), text("text")))).alias("turns")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = chat_encoder(tokenizer_path)
        schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("token_starts", pa.list_(pa.int32())), ("token_ends", pa.list_(pa.int32())), ("loss", pa.list_(pa.bool_()))])
        for batch in batches:
            made = [render([(x["role"], x["text"]) for x in said]) for said in batch.column(1).to_pylist()]
            texts = pa.array([t for t, _ in made], pa.large_string())
            for low, high, data, offsets in runs(*text_bytes(texts)):
                lists: list[list[np.ndarray]] = [[], [], [], []]
                for (ids, start, end), (_, spans) in zip(encoded(encoder, data, offsets), made[low:high], strict=True):
                    for column, x in zip(lists, (ids, start, end, token_mask(start, end, spans)), strict=True):
                        column.append(x)
                at = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists[0]])]).astype(np.int32))
                flat = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x), t)) for x, t in zip(lists, [pa.int32()] * 3 + [pa.bool_()], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), texts.slice(low, high - low).cast(pa.string()), *flat], schema=schema)

    return whole.mapInArrow(run, SCHEMA)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what ``format_conversations`` wrote, taken from its output alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for batch in batches:
            out = []
            for conv, text, starts, ends, loss in zip(*(batch.column(i) for i in range(5)), strict=True):
                text = text.as_py()
                turns = parse(text)
                learnt = masked_text(text, *(np.array(x.values.to_numpy(zero_copy_only=False)) for x in (starts, ends, loss)))
                digest = sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                out.append((conv.as_py(), len(turns), digest, len(learnt), sha256(learnt.encode()).hexdigest(), len(text)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return formatted.select("conv_id", "formatted", "token_starts", "token_ends", "loss").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
