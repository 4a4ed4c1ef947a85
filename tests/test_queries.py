from collections import Counter

import duckdb

from webextract import queries
from webextract.operators import fetch, jobs, nodes
from webextract.sources import html as H


def same_as_sql(spark, tmp_path, name, urls, html="<h1>t</h1>"):
    """Whether a query gives the rows of its SQL over pages of ``urls``, each of another length."""
    rows = [(i, u, html + "x" * i) for i, u in enumerate(urls)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = queries.QUERIES[name](spark, str(tmp_path))
    want = duckdb.sql(queries.ORACLES[name])
    assert got.columns == want.columns
    return Counter(map(tuple, got.collect())) == Counter(want.fetchall())


#: Pages of one URL, of URLs that differ in writing only, and of none.
TWICE = ["http://h/a", "http://h/a", "HTTP://H/a#x", "http://h/a?q=1", "http://h/a?q=1", "http://h/b#y?z", "http://h/b", "http://h/b#", "http://h", "http://h/", None, None, "http://h/a"]


def test_visited_pages_of_one_url(spark, tmp_path):
    assert same_as_sql(spark, tmp_path, "j2_not_visited", TWICE)


def test_cached_answers_of_one_url(spark, tmp_path):
    assert same_as_sql(spark, tmp_path, "j7_response_cache", TWICE)
    asked = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "key string")
    stored = spark.createDataFrame([("a", 9, 1), ("a", 3, 2), ("b", None, 1), (None, 4, 1)], "key string, answer long, place int")
    show = lambda df: sorted((str(r.key), r.answer, r.hit) for r in df.collect())
    assert show(jobs.response_cache(asked, stored).drop("place")) == [("None", None, False), ("a", 3, True), ("a", 3, True), ("b", None, False)]
    assert show(jobs.response_cache(asked, stored.drop("place")))[1:3] == [("a", 9, True)] * 2


def test_snapshots_of_one_url(spark, tmp_path):
    assert same_as_sql(spark, tmp_path, "j9_fetch_snapshot", TWICE)
    wanted = spark.createDataFrame([("h/a", 1), ("h/a", 2), (None, 3)], "url string, n int")
    snapshot = spark.createDataFrame([("http://h/a#2", "B", 200), ("http://h/a", "C", 404), ("http://h/a", "A", 404), (None, "N", 200)], "url string, html string, status int")
    got = sorted((r.n, r.html, r.status, r.error) for r in fetch.from_snapshot(wanted, snapshot).collect())
    assert got == [(1, "A", 404, None), (2, "A", 404, None), (3, None, None, "Not in snapshot: ")]


def test_titles_with_cut_references(spark, tmp_path):
    h1 = "<h1> R&amp;D &lt;b&gt; &amp;lt; &copy; &nbspx &quot &amp </h1>"
    assert same_as_sql(spark, tmp_path, "w8_title", ["http://h/a", "http://h/b"], h1)
    page = H.page_of(spark, "<h1>R&ampD &lt</h1>")  # the operator itself keeps to the rule of HTML
    assert nodes.titles(nodes.cleaned(H.parse_nodes(page)), page).first().title == "R&D <"
