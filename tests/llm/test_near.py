import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from webextract.llm import components, jaccard_join, queries, words

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width=5):
    w = SPACED.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def brute_groups(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, (_, s) in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    tried = set()
    for own in holders.values():
        for i in own:
            for j in own:
                if i < j and (i, j) not in tried:
                    tried.add((i, j))
                    a, b = sets[i][1], sets[j][1]
                    if 100 * len(a & b) >= 75 * len(a | b):
                        parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(sets):
        r = find(i)
        low[r] = d if r not in low or (d is not None and d < low[r]) else low[r]
    return sorted(((d, len(s), low[find(i)]) for i, (d, s) in enumerate(sets)), key=str)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_groups(rows)
    assert got(queries.QUERIES["op9_jaccard_join"](spark, sf)) == want
    assert sum(d != c for d, _, c in want) > 20


def make_rows(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randrange(30))
    rows, passage = [], [word() for _ in range(60)]
    for base_size in (5, 7, 12, 40, 90, 300):
        base = [word() for _ in range(base_size)]
        for _ in range(30):
            w = list(base)
            for _ in range(rng.randrange(1 + max(1, base_size // 25))):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = [word()] * rng.randrange(3)
            rows.append(" ".join(w))
        chain = list(base)
        for _ in range(20):  # each near the last, far from the first
            chain = chain[max(1, base_size // 20) :] + [word() for _ in range(max(1, base_size // 20))]
            rows.append(" ".join(chain))
        rows += [" ".join(base)] * 5
        for _ in range(15):  # a shared passage only
            rows.append(" ".join([word() for _ in range(base_size)] + passage))
    rng.shuffle(rows)
    return [(3 * i + 1, t) for i, t in enumerate(rows)]


def test_mixed_groups(spark, monkeypatch):
    rows = make_rows(1)
    want = brute_groups(rows)
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, rep int")
    assert got(jaccard_join.near_duplicates(df)) == want
    for name, value in (("SMALL_GROUP", 3), ("DEALT", 2), ("BLOCK_BYTES", 4000)):
        monkeypatch.setattr(jaccard_join, name, value)
    monkeypatch.setattr(jaccard_join, "IDS_TO_BROADCAST", 3)
    monkeypatch.setattr(jaccard_join, "BLOCK", (3, 5))
    monkeypatch.setattr(jaccard_join, "PARTNERS", 4)
    assert got(jaccard_join.near_duplicates(df.repartition(6))) == want


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A b"), (5, "a B"), (5, "a B"), (None, "a b"), (7, "x" * 50_000), (8, "w " * 30_000), (9, "w " * 20_000), (10, "a b c d e f g"), (-4, "a\tb")]
    df = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, component_id string")
    assert got(jaccard_join.near_duplicates(df)) == brute_groups(rows)
    assert jaccard_join.near_duplicates(df.limit(0)).collect() == []
    assert jaccard_join.one_of_each(df.limit(0)).collect() == []


def test_two_texts_of_one_id(spark):
    """Each text of an id is linked by itself, whichever comes first; rows of no id link others."""
    rng = random.Random(3)
    a, b, c = ([f"w{rng.randrange(10**6)}" for _ in range(100)] for _ in range(3))
    near = lambda w, n: " ".join(w[n:])
    rows = [(5, near(a, 0)), (5, near(b, 0)), (9, near(b, 3)), (12, near(c, 0)), (None, near(c, 14)), (13, near(c, 28)), (None, "x y"), (None, "x y")]
    want = brute_groups(rows)
    assert (9, 93, 5) in want and (13, 68, 12) in want
    for order in (rows, rows[::-1]):
        for parts in (1, 4):
            df = spark.createDataFrame(order, "doc_id long, text string").repartition(parts)
            assert got(jaccard_join.near_duplicates(df)) == want
            kept = jaccard_join.one_of_each(df.selectExpr("doc_id", "text", "map('a', 1) AS near_key", "1 AS id", "2 AS h1")).collect()
            assert sorted((r.doc_id for r in kept), key=str) == [12, 5, 5, None]


def test_words_of_one_polynomial(spark):
    """Words that a polynomial modulo a power of two does not tell apart (Thue-Morse) are told apart."""
    u = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    v = u.translate(str.maketrans("ab", "ba"))
    h = words.split(*words.text_bytes(pa.array([f"{u} {v}"])), words.SPACED).hashes()
    assert h[0] != h[1]
    rows = [(1, " ".join([u] + ["x"] * 4)), (2, " ".join([v] + ["x"] * 4))]
    assert got(jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == [(1, 1, 1), (2, 1, 2)]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 400))
def test_linked_sets_share_a_key(seed, n):
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 10**6, n + 4)]
    other = list(base)
    for _ in range(int(rng.integers(0, max(2, n // 30)))):
        other[int(rng.integers(0, len(other)))] = f"v{rng.integers(0, 10**6)}"
    other = other[: len(other) - int(rng.integers(0, max(1, n // 8)))]
    texts = [" ".join(base), " ".join(other)]
    a, b = map(shingles, texts)
    s = jaccard_join.Sets(*words.text_bytes(pa.array(texts)))
    assert s.n.tolist() == [len(a), len(b)]
    of, key, spare = s.keys()
    if 100 * len(a & b) >= 75 * len(a | b):  # whatever the order of keys, the first of them have one in common
        order = rng.permutation(1 << 16)
        for bit in (0, 1):
            first = []
            for i in (0, 1):
                own = sorted(key[(of == i) & (key & np.uint64(1) == bit)].tolist(), key=lambda k: (order[k & 0xFFFF], k))
                first.append(set(own[: max(0, len(own) - max(0, int(spare[bit][i])))]))
            if first[0] & first[1]:
                break
        else:
            raise AssertionError
    assert jaccard_join.hamming(*map(jaccard_join.sketch, s.each())) <= len(a ^ b)


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 90)] + [(200, 300 + i) for i in range(50)] + [(rng.randrange(400, 800), rng.randrange(400, 800)) for _ in range(250)] + [(5, 5), (None, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long")
    assert sorted(map(tuple, components.connected_components(df).collect())) == sorted((x, find(x)) for x in parent)
    assert components.connected_components(df.limit(0)).collect() == []
