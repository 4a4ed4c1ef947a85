import duckdb
import numpy as np
from pyspark.sql import functions as F

from webextract.llm import mixing, queries, topk_search


def brute_top(rows, k, every, scale=64):
    rows = [(i, np.floor(scale * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in rows:
        if i % every == 0:
            best = sorted((-int(q @ v), j) for j, v in rows if j != i and len(v) == len(q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def test_topk(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK_ROWS", 70)
    monkeypatch.setattr(topk_search, "QUERY_ROWS", 5)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.1, 6)]) for i in range(0, 300)]
    rows += [(1000 + i, [0.25] * 6) for i in range(60)]  # ties
    rows += [(40_000, None), (40_020, [0.1, None] * 3), (40_040, [float("nan")] * 6), (None, [0.1] * 6), (40_060, []), (40_080, [float("inf")] * 6)]
    rows += [(50_000, [1.0, -2.0]), (50_001, [3.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = sorted(map(tuple, topk_search.top_k(df, F.col("vec_id") % 20 == 0).collect()))
    assert got == brute_top(rows, 20, 20)
    assert topk_search.top_k(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    one = df.filter("vec_id = 0")
    assert topk_search.top_k(one, F.col("vec_id") % 20 == 0).collect() == []


def test_mix(spark):
    rows = [(i, " ".join(["w"] * (i % 7)), None if i % 5 == 0 else f"s{i % 3}" if i % 11 else "é") for i in range(400)]
    rows += [(900, None, "s1"), (901, "a " * 5000, "z"), (902, "", None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, size string")
    got = sorted(map(tuple, mixing.fair_mix(df).select("doc_id", "size", "source_size", "target", "taken").collect()))
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = sorted(con.execute(mixing.SQL).fetchall())
    assert got == want
    total, largest = sum(x[1] for x in got), {}
    taken = {}
    for d, size, s, target, t in got:
        assert t <= 2 * size
        key = (s, target)
        taken[key] = taken.get(key, 0) + t
        largest[key] = max(largest.get(key, 0), size)
    assert abs(sum(t for _, t in taken) - 1.5 * total) < 1e-6
    assert all(abs(v - k[1]) <= largest[k] + max(largest.values()) * 0 for k, v in taken.items())
    assert mixing.fair_mix(df.limit(0)).collect() == []
    assert [r.taken for r in mixing.fair_mix(df.filter("doc_id >= 900 and doc_id != 901")).collect()] == [0, 0]
    again = sorted(map(tuple, mixing.fair_mix(df.repartition(5)).select("doc_id", "size", "source_size", "target", "taken").collect()))
    assert again == got


def test_mix_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b", "x")] * 4 + [(2, "c d", "y")] * 3, "doc_id long, text string, source string")
    rows = mixing.fair_mix(df).collect()
    assert len(rows) == 7 and all(r.taken in (0, 2, 4) for r in rows)


def test_mixed_rows_are_the_mix(spark):
    """The rows given are as many as the mix takes, alike or not, whatever their columns are called."""
    rows = [(1, "a b", "x")] * 5 + [(2, "c d", "y")] * 3 + [(None, "q r s", "x")] * 4 + [(1, "e f", "x"), (3, None, None), (4, "", "y"), (5, "z " * 9000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS mix_row", "2 AS `Mix_Copies`", "map(1, 2) AS `a.b`", "3 AS size")
    plan = mixing.fair_mix(df)
    got = mixing.mixed(df)
    assert got.columns == df.columns
    assert got.count() == plan.agg(F.sum("copies")).first()[0]
    words = got.agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert words == plan.agg(F.sum("taken")).first()[0] <= 1.5 * plan.agg(F.sum("size")).first()[0]
    assert mixing.mixed(df.limit(0)).collect() == []


def test_registered():
    assert {"op4_source_mix", "op5_bit_sliced_topk"} <= queries.ORACLES.keys()
