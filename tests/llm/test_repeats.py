import random
import re
from hashlib import sha256

from pyspark.sql import functions as F

from webextract.llm import queries, substring_dedup

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width=13):
    owner, split = {}, []
    for d, t in rows:
        w = SPACED.findall(t or "")
        split.append((d, w))
        if d is not None:
            for i in range(len(w) - width + 1):
                k = tuple(w[i : i + width])
                owner[k] = min(owner.get(k, d), d)
    out = []
    for d, w in split:
        gone = set()
        if d is not None:
            for i in range(len(w) - width + 1):
                if owner[tuple(w[i : i + width])] < d:
                    gone |= set(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    assert sorted(map(tuple, queries.QUERIES["op8_substring_dedup"](spark, sf).collect()), key=str) == want
    assert sum(r[2] > 0 for r in want) > 20


def test_odd_rows(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda: rng.choice(["é", "a", "b.", "C", "日", "x" * rng.randrange(1, 9)])
    long_ = [word() + str(rng.randrange(50)) for _ in range(300)]
    rows = [(50 - i, " \n".join(long_[: rng.randrange(300)] + [word() for _ in range(20)] + long_[rng.randrange(200) :]) + "\t") for i in range(30)]
    rows += [(60, None), (61, ""), (62, " ".join(["w"] * 13)), (63, " ".join(["w"] * 40)), (64, " ".join(["w"] * 12)), (None, " ".join(long_)), (65, " ".join(long_)), (65, " ".join(long_[5:90])), (66, "v " * 40_000), (67, "v " * 14), (67, "v " * 14)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, id int").repartition(4)
    want = brute(rows)

    def got(**options):
        out = substring_dedup.without_repeats(df, **options).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
        return sorted(map(tuple, out.collect()), key=str)

    assert got() == want
    for name, value in (("SHARD_WINDOWS", 40), ("TASK_DOCS", 3), ("AUTOMATON_WINDOWS", 30), ("SPANS_TO_BROADCAST", 1)):
        monkeypatch.setattr(substring_dedup, name, value)
    assert got() == want
    assert got(key_bytes=1) == want  # many clashes
    assert substring_dedup.without_repeats(df.limit(0)).collect() == []


def test_words_of_one_polynomial(spark):
    """Words that a polynomial modulo a power of two does not tell apart are not taken for each other."""
    u = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    v = u.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, " ".join([u] * 13)), (2, " ".join([v] * 13)), (3, " ".join([v] * 13))], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substring_dedup.without_repeats(df).collect()}
    assert got == {1: 0, 2: 0, 3: 13}
