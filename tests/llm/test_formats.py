import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webextract.llm import chat_format, queries, token_tables, words
from webextract.llm.encoding import PartEncoder

tokenizer_file = queries.tokenizer_path()
PLAIN, CHAT = token_tables.load_tokenizer(tokenizer_file), chat_format.chat_tokenizer(tokenizer_file)


@pytest.fixture(scope="module")
def tokenizer():
    return token_tables.load_tokenizer(tokenizer_file)


texts = st.lists(st.text(alphabet="ab é 　 \t\n\r\x0b\x85'<|>\\endoftext1.!日s", max_size=40), max_size=12)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_parts_encode_like_whole_texts(given):
    t = PLAIN
    data, offsets = words.text_bytes(pa.array(given, pa.string()))
    ids, sizes = PartEncoder(t).encode(data, offsets)
    want = [t.encode(x, add_special_tokens=False).ids for x in given]
    assert sizes.tolist() == [len(x) for x in want]
    assert ids.tolist() == [i for x in want for i in x]


def test_parts_of_one_polynomial(tokenizer, monkeypatch):
    """Parts that a polynomial modulo a power of two does not tell apart have their own ids, and so have parts of one hash."""
    u = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    v = u.translate(str.maketrans("ab", "ba"))

    def check():
        e = PartEncoder(tokenizer)
        for given in ([u], [v], [u, v, "one two", "two one"], ["one", "six"]):
            ids, sizes = e.encode(*words.text_bytes(pa.array(given)))
            assert ids.tolist() == [i for x in given for i in tokenizer.encode(x, add_special_tokens=False).ids]

    check()
    own = words.byte_hashes
    monkeypatch.setattr("webextract.llm.encoding.byte_hashes", lambda d, a, b, seed=0: own(d, a, b, seed) % np.uint64(3) if seed == 3 else own(d, a, b, seed))
    check()


def test_part_store_forgets(tokenizer, monkeypatch):
    for most in (3, 4, 7):
        monkeypatch.setattr("webextract.llm.encoding.MEMO_PARTS", most)
        e = PartEncoder(tokenizer)
        for text in ("one two", "three four", "a b c d e f g h", "one two", "one, two. one! three", "one five six", "seven one", "one"):
            data, offsets = words.text_bytes(pa.array([text]))
            assert e.encode(data, offsets)[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
            assert len(e.keys) <= most


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|turn|>", ""]), st.text(alphabet="a<|>\\ turnexd日\n", max_size=20)), max_size=5))
def test_chat_round_trip(turns):
    formatted, spans = chat_format.render(turns)
    assert chat_format.parse(formatted) == turns
    code = CHAT.encode(formatted, add_special_tokens=False)
    at = np.array(code.offsets, np.int32).reshape(-1, 2)
    mask = chat_format.token_mask(at[:, 0], at[:, 1], spans)
    assert chat_format.masked_text(formatted, at[:, 0], at[:, 1], mask) == "".join(t for r, t in turns if r == "assistant")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a b"]), st.text(alphabet="a<|>\\ turnexd日é\n\t🎈 ", max_size=30)), max_size=4), max_size=4))
def test_chat_tokens_are_those_of_whole_texts(conversations):
    given = [chat_format.render(c)[0] for c in conversations]
    got = chat_format.encoded(PartEncoder(CHAT), *words.text_bytes(pa.array(given, pa.string())))
    for text, (ids, start, end) in zip(given, got, strict=True):
        code = CHAT.encode(text, add_special_tokens=False)
        assert ids.tolist() == code.ids and list(zip(start.tolist(), end.tolist())) == code.offsets


def test_chat_odd_rows(spark):
    rows = [(1, 1, "assistant", "b", 9), (1, 0, "user", None, 9), (2, 0, None, "x", 9), (None, 0, "assistant", "n", 9), (1, 1, "assistant", "b", 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(df, tokenizer_file)).collect()}
    assert got[1].n_turns == 3 and got[1].turns_sha256 == sha256(b"user\n\nassistant\nb\nassistant\nb\n").hexdigest()
    assert got[1].loss_chars == 2 and got[1].loss_sha256 == sha256(b"bb").hexdigest()
    assert got[2].loss_chars == 0 and got[None].loss_chars == 1
    assert chat_format.format_conversations(df.limit(0), tokenizer_file).count() == 0
    long_ = [(7, 0, "user", "é x " * 200_000), (7, 1, "assistant", "y" * 300_000 + " end")]
    row = chat_format.read_back(chat_format.format_conversations(spark.createDataFrame(long_, "conv_id long, turn long, role string, text string"), tokenizer_file)).first()
    assert row.loss_sha256 == sha256(long_[1][3].encode()).hexdigest() and row.n_turns == 2


def test_chat_query(spark, small):
    got = {r.conv_id: r for r in queries.QUERIES["op6_chat_masks"](spark, small).collect()}
    said = {}
    for r in spark.read.parquet(f"{small}/conversations.parquet").collect():
        said.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    said[-7] = [(0, "user", r"\### Assistant: </turn> ok"), (1, "assistant", r"\### Assistant: </turn> ok")]
    assert got.keys() == said.keys()
    for conv, turns in said.items():
        turns.sort()
        learnt = "".join(t for _, r, t in turns if r == "assistant")
        assert got[conv].turns_sha256 == sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].loss_chars, got[conv].loss_sha256) == (len(turns), len(learnt), sha256(learnt.encode()).hexdigest())


def brute_tokens(rows, tokenizer):
    start, out = 0, []
    for doc, text in sorted(rows):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_table_query(spark, small, tokenizer):
    got = sorted(map(tuple, queries.QUERIES["op7_token_tables"](spark, small).collect()))
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert got == brute_tokens(rows, tokenizer)


def test_token_table_files(spark, small, tmp_path, monkeypatch):
    """The files have dictionary pages, several bounded row groups, and page indexes."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(token_tables, "FILE_BYTES", 100_000)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    big = docs.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(12)))).select((F.col("doc_id") * 100 + F.col("copy")).alias("doc_id"), "text").coalesce(1)
    token_tables.write_token_table(big, f"file://{tmp_path}/t", tokenizer_file)
    low, groups = None, 0
    assert len(list(tmp_path.glob("t/part-*.parquet"))) > 4  # more than the session's partitions
    for f in sorted(tmp_path.glob("t/part-*.parquet")):
        meta = pq.ParquetFile(f).metadata
        ids = [j for j in range(meta.num_columns) if meta.schema.column(j).path.startswith("ids")][0]
        groups = max(groups, meta.num_row_groups)
        for g in range(meta.num_row_groups):
            column, key = meta.row_group(g).column(ids), meta.row_group(g).column(0)
            assert column.has_dictionary_page and {"PLAIN_DICTIONARY", "RLE_DICTIONARY"} & set(column.encodings) and column.total_uncompressed_size <= 2 * token_tables.ROW_GROUP_BYTES
            assert key.statistics.has_min_max and (low is None or key.statistics.min >= low)
            assert key.has_column_index and key.has_offset_index and column.has_offset_index
            low = key.statistics.max
    assert groups >= 1


def test_token_table_odd_rows(spark, tokenizer, tmp_path):
    rows = [(5, None), (3, ""), (9, "x " * 70_000), (5, "two"), (3, ""), (1, "\n\n a  b")]
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, ids int").repartition(3)
    table = token_tables.token_table(df, tokenizer_file, f"file://{tmp_path}/t")
    want = brute_tokens([(d, t or "") for d, t in rows], tokenizer)
    assert sorted(map(tuple, token_tables.with_crc(table).collect())) == sorted(want)
    plan = table.filter(F.col("doc_id") == 9).select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,9)" in plan and "ids:array" not in plan
    empty = token_tables.token_table(df.limit(0), tokenizer_file, f"file://{tmp_path}/e")
    assert token_tables.with_crc(empty).collect() == []
