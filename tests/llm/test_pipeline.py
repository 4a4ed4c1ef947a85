import corpus_pipeline
import duckdb

from test_formats import brute_tokens
from test_near import brute_groups
from test_scans import brute_contamination
from webextract.llm import jaccard_join, mixing, queries, token_tables
from webextract.session import staged


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_against_brute_force(spark, small, tables):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "jaccard_join", "decontamination", "source_mix", "token_tables"]
    kinds = docs.dtypes

    kept = staged(stages["toxicity"](spark, docs, small), "t")
    toxic = {r.doc_id for r in queries.QUERIES["op2_toxicity"](spark, small).filter("predicted = 1").collect()}
    assert kept.dtypes == kinds and rows_of(kept) == rows_of(docs.filter(~docs.doc_id.isin(list(toxic) or [-1])))

    before, kept = kept, staged(stages["jaccard_join"](spark, kept, small), "j")
    stay = {d for d, _, c in brute_groups([(r.doc_id, r.text) for r in before.collect()]) if d == c}
    assert kept.dtypes == kinds and rows_of(kept) == [r for r in rows_of(before) if r[0] in stay]

    before, kept = kept, staged(stages["decontamination"](spark, kept, small), "d")
    b = tables["benchmark"]
    bad = {r[0] for r in brute_contamination([(r.doc_id, r.text) for r in before.collect()], list(zip(b.item_id.tolist(), b.text.tolist()))) if r[5]}
    assert kept.dtypes == kinds and rows_of(kept) == [r for r in rows_of(before) if r[0] not in bad]

    before, kept = kept, staged(stages["source_mix"](spark, kept, small), "m")
    con = duckdb.connect()
    con.register("documents", before.toPandas())
    copies = {d: (t // s if s else None) for d, s, _, _, t in con.execute(mixing.SQL).fetchall()}
    want = sorted((r for r in rows_of(before) for _ in range(copies[r[0]] or 0)), key=str)
    assert kept.dtypes == kinds and [r for r in rows_of(kept) if copies[r[0]] is not None] == want

    last = rows_of(stages["token_tables"](spark, kept, small))
    want = sorted(brute_tokens([(r.doc_id, r.text) for r in kept.collect()], token_tables.load_tokenizer(queries.tokenizer_path())), key=str)
    assert last == want
    assert rows_of(corpus_pipeline.run(spark, small)) == want


def test_odd_rows(spark, small):
    rows = [(1, "a b", "en", None, 3), (1, "a b", "en", None, 3), (1, "a c", "en", "s", 3), (2, None, None, "s", None), (3, "", "fr", "s", 0), (4, "A  b", "en", None, 3), (None, "q r s", "en", "s", 5), (5, "z " * 30_000, "en", "s", 9)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{small}/documents.parquet").schema)
    assert rows_of(jaccard_join.one_of_each(docs)) == sorted([rows[0], *rows[2:5], *rows[6:]], key=str)
    mixed = rows_of(mixing.mixed(docs))
    assert set(mixed) <= set(rows) and all(mixed.count(r) <= 2 * rows.count(r) for r in rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), small).collect() == []
        stage(spark, docs, small).collect()
