import json

import pytest
from pyspark.sql import functions as F

from webextract.functions import text as T
from webextract.functions import urls as U
from webextract.operators import article, crawl
from webextract.sources import sitemaps
from webextract.streaming import state


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("f", "given", "want"), [
    (U.flat_filename, "https://example.com/blog/post-1", "example.com__blog__post-1.md"),
    (U.flat_filename, "https://example.com/", "example.com__index.md"),
    (U.flat_filename, "https://Example.com:80/a//b c?x=1&y", "example.com_80__a__b_c_x_1_y.md"),
    (U.stripped, "https://user:pw@Example.com:8443/path?q=1#f", "https://example.com:8443/path"),
    (U.stripped, "example.com/path", "example.com/path"),
    (U.normalized, " Example.com/a#b ", "http://example.com/a"), (U.normalized, "host:80/x", None), (U.normalized, "  ", None),
    (U.discovered, "HTTPS://Ex.com?q=1", "https://Ex.com/"), (U.discovered, "mailto:x", None),
    (U.title_from_url, "https://e.com/under_score", "Under Score"), (U.title_from_url, "https://e.com/it's-3d", "It'S 3D"), (U.title_from_url, "https://e.com/", None),
    (U.is_safe, " JavaScript:x", False), (U.is_safe, "data:text/html,x", False), (U.is_safe, "https://x", True),
    (U.host, "https://www.Example.com/x", "example.com"),
    (T.word_count, "hello   world", 2), (T.word_count, "   ", 0), (T.word_count, "a b\nc", 3),
    (T.is_image_source, "my-pixel-art.png", True), (T.is_image_source, "spacer-component.png", True), (T.is_image_source, "/pixel.gif", False),
    (T.is_image_source, "https://example.com/assets/my-pixel.gif", True), (T.is_image_source, "https://cdn.example.com/t.gif", False),
    (T.is_image_source, "https://tracking.example.com/image.jpg", False), (T.is_image_source, "https://myanalytics.com/image.jpg", True),
    (T.is_image_source, "photo-1x1-ratio.png", True), (T.is_image_source, "x.jpg", False), (T.is_image_source, None, False),
])
def test_vectors(spark, f, given, want):
    assert one(spark, f, given) == want
    if f is T.is_image_source:
        assert article.is_image_source(given) == want


def test_more_vectors(spark):
    md = lambda u: one(spark, lambda c: U.markdown_url(c, F.lit(False)), u)
    assert md("https://example.com/docs/page.html?x=1") == "https://example.com/docs/page.md"
    assert md("https://example.com/assets/image.png") == "https://example.com/assets/image.png"
    for n, s in ((1, 0.3), (3, 0.9), (4, 1.2), (5, 1.5), (100, 1.5)):
        assert spark.range(1).select(T.backoff(F.lit(n)).alias("s")).first().s == pytest.approx(s)
    rules = [".example.com", "*.svc.cluster.local", "api.internal:8080"]
    for h, want in (("foo.example.com", True), ("bar.svc.cluster.local", True), ("api.internal", True), ("public.example.net", False), (None, True), ("", True)):
        assert one(spark, lambda c: U.bypasses_proxy(c, rules), h) is want
    raw = spark.createDataFrame([(b"caf\xc3\xa9",), (b"caf\xe9",)], "b binary").select(T.decoded(F.col("b")).alias("t")).collect()
    assert [r.t for r in raw] == ["café", "café"]
    assert one(spark, T.excerpt, "w" * 150 + " " + "x" * 100) == "w" * 150 + "..."
    assert one(spark, T.excerpt, "w" * 100 + " " + "x" * 150) == "w" * 100 + " " + "x" * 99 + "..."


def test_sitemaps(spark):
    docs = [("i.xml", "<sitemapindex><sitemap><loc>i.xml</loc></sitemap><sitemap><loc> s.xml </loc></sitemap><sitemap><loc>https://r/s.xml</loc></sitemap></sitemapindex>", None), ("s.xml", "<urlset xmlns='n'><url><loc>https://a/1</loc></url><url><loc/></url></urlset>", 200), ("https://r/s.xml", "<urlset><loc>https://r/1</loc></urlset>", 200), ("https://r/i.xml", "<sitemapindex><loc>https://r/s.xml</loc><loc>https://r/bad.xml</loc></sitemapindex>", 200), ("https://r/bad.xml", "<urlset><loc>https://r/2</loc></urlset>", 404), ("m.xml", "<oops", None)]
    known = spark.createDataFrame(docs, "source string, xml string, status int")
    got = sitemaps.load(spark.createDataFrame([("i.xml",), ("https://r/i.xml",), ("m.xml",), ("none.xml",)], "source string"), known)
    assert sorted(map(tuple, got.collect())) == [("https://r/i.xml", [0, 0], "https://r/1"), ("i.xml", [1, 0], "https://a/1")]
    assert [r.x for r in spark.createDataFrame([("a/b",), ("s.xml",), ("http://h/s.xml",), ("s",)], "s string").select(sitemaps.is_local(F.col("s")).alias("x")).collect()] == [True, True, False, False]
    assert spark.range(1).select(sitemaps.is_local(F.lit("s"), F.lit(True)).alias("x")).first().x


def test_deep_sitemaps(spark):
    docs = [(f"{i}.xml", f"<sitemapindex><loc>{i + 1}.xml</loc><loc>0.xml</loc></sitemapindex>", 200) for i in range(22)] + [("22.xml", "<urlset><loc>https://a/1</loc></urlset>", 200)]
    got = sitemaps.load(spark.createDataFrame([("0.xml",)], "source string"), spark.createDataFrame(docs, "source string, xml string, status int"))
    assert [(r.source, r.url) for r in got.collect()] == [("0.xml", "https://a/1")]


def test_breadth_first(spark):
    edges = [("a", 0, "b"), ("a", 1, "c"), ("b", 0, "d"), ("c", 0, "d"), ("c", 1, "a"), ("d", 0, "e"), ("e", 0, "f"), ("b", 1, "x")]
    url = lambda n: f"http://h/{n}"
    df = spark.createDataFrame([(url(a), p, url(b)) for a, p, b in edges], "src string, pos int, dst string")
    run = lambda **k: [(r.url[-1], r.depth, r.parent and r.parent[-1]) for r in crawl.breadth_first(spark, crawl.CrawlConfig(seeds=("h/a", "http://h/a", ""), deny_prefixes=("http://h/x",), **k), df).orderBy("seq").collect()]
    assert run() == [("a", 0, None), ("b", 1, "a"), ("c", 1, "a"), ("d", 2, "b"), ("e", 3, "d")]
    assert run(max_pages=3) == [("a", 0, None), ("b", 1, "a"), ("c", 1, "a")]
    assert run(follow_links=False) == [("a", 0, None)]
    pages = spark.createDataFrame([(1, url("a"), "<a href=b>b</a><a href='/c#x'>c</a>"), (2, url("b"), "<a href=/d>d</a><a href=/a>a</a>"), (3, url("c"), "")], "page_id long, url string, html string")
    config = crawl.CrawlConfig(seeds=("h/c", "h/a"), sitemaps=("s.xml",), allow_prefixes=("HTTP://H", "::"), max_depth=5)
    maps = spark.createDataFrame([("s.xml", "<urlset><loc>http://h/z</loc><loc>http://other/z</loc><loc>http://h/a</loc></urlset>", 200)], "source string, xml string, status int")
    got = crawl.breadth_first(spark, config, crawl.from_pages(pages), sitemap_documents=maps).orderBy("seq").collect()
    assert [(r.url[-1], r.depth, r.seq) for r in got] == [("c", 0, 1), ("a", 0, 2), ("z", 0, 3), ("b", 1, 4), ("d", 2, 5)]
    skipped = crawl.breadth_first(spark, config, crawl.from_pages(pages), skip=spark.createDataFrame([(url("a"),)], "url string"))
    assert {r.url[-1] for r in skipped.collect()} == {"c", "a"}
    assert sorted((r.src[-1], r.pos, r.dst[-1]) for r in crawl.page_edges(pages).collect()) == [("a", 0, "b"), ("a", 1, "c"), ("b", 0, "d"), ("b", 1, "a")]


def test_links_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://h/d/p", "<a href='q'>x</a><div href='/r'></div><a href='mailto:x'></a><a href='q'>"), (2, None, None)], "page_id long, url string, html string")
    assert [r.link for r in crawl.extract_links(df).orderBy("pos").collect()] == ["http://h/d/q", "http://h/d/q"]
    assert {r.link for r in crawl.extract_links(df, only_a=False, http_only=False).collect()} == {"http://h/d/q", "http://h/r", "mailto:x"}
    results = crawl.crawl_results(article.extract_articles(df.withColumn("html", F.lit("<article><p>some text</p></article>"))), F.lit("t"))
    crawl.write_manifest(crawl.manifest(results, crawl.CrawlConfig(), "j", "a", "b", 1.5), f"{tmp_path}/manifest.json")
    said = json.loads((tmp_path / "manifest.json").read_text())
    assert said["total_pages"] == 2 and said["config"]["max_pages"] == 100 and len(said["results"]) == 2
    crawl.write_manifest(crawl.manifest(results.limit(0), crawl.CrawlConfig(), "j", "a", "b", 1.5), f"{tmp_path}/empty.json")
    assert json.loads((tmp_path / "empty.json").read_text())["results"] == []
    seq = results.withColumn("seq", F.when(F.col("url") == "", 1).otherwise(2))
    crawl.write_manifest(crawl.manifest(seq, crawl.CrawlConfig(), "j", "a", "b", 1.5), f"{tmp_path}/manifest.json")
    assert [r["url"] for r in json.loads((tmp_path / "manifest.json").read_text())["results"]] == ["", "http://h/d/p"]
    good = results.filter("url <> ''")
    (tmp_path / "blocked").write_text("")
    left = crawl.write_markdown(good, f"{tmp_path}/blocked").first()
    assert left.status == "failed" and left.error.startswith("Write failed: ") and left.file_path is None
    assert crawl.write_markdown(good, f"{tmp_path}/md").first().status == "success"
    assert (tmp_path / "md/h__d__p.md").read_text() == '---\nurl: http://h/d/p\ntitle: "P"\nextracted_at: t\nword_count: 2\n---\n\nsome text'
    back = crawl.load_manifest(spark, f"{tmp_path}/manifest.json")
    assert back.first().successful == 2 and crawl.load_manifest(spark, f"{tmp_path}/none.json") is None
    (tmp_path / "bad.json").write_text("{nope")
    assert crawl.load_manifest(spark, f"{tmp_path}/bad.json") is None
    lines = spark.createDataFrame([(0, " b "), (1, "#c"), (2, ""), (3, "a"), (4, "b")], "pos int, line string")
    assert [r.url for r in crawl.load_url_list(lines).orderBy("pos").collect()] == ["b", "a"]


def test_state_steps():
    s = state.RATE_START
    for _ in range(10):
        s = state.rate_step(s, 0.0, False)
    assert s[0] == pytest.approx(1.8)
    delays = []
    for t in (0, 2, 4):
        s = state.rate_step(s, float(t), True)
        delays.append(s[0])
    assert delays == sorted(delays) and delays[-1] == pytest.approx(1.8 * 1.25 * 2 * 3)
    assert state.limit_step((4, 0, -1.0), 0.0, True)[0] == 2
    lim = (1, 0, -1.0)
    for i in range(25):
        lim = state.limit_step(lim, float(i), False, 1, 2)
    assert lim[0] == 2


def test_waits_and_rings(spark):
    rows = [(k, float(t), i, i % 3 == 0) for k in (1, 2) for i, t in enumerate([0, 1, 1, 50, 290, 300, 301, 301, 600, 1000])]
    df = spark.createDataFrame(rows, "key long, ts double, seq long, limited boolean")
    for size in (3, 100):
        got = {(r.key, r.seq): r.share for r in state.recent_limit_share(df, ring=size).collect()}
        for k, ts, seq, _ in rows:
            near = [x for x in rows if x[0] == k and x[2] <= seq][-size:]
            near = [x[3] for x in near if x[1] > ts - 300]
            assert got[k, seq] == pytest.approx(sum(near) / len(near))
    waits = df.withColumn("delay", F.lit(2.0) + F.col("seq"))
    got = {(r.key, r.seq): r.start for r in state.one_after_another(waits).collect()}
    for k in (1, 2):
        last = -1e18
        for _, ts, seq, _ in (r for r in rows if r[0] == k):
            last = max(ts, last + 2.0 + seq)
            assert got[k, seq] == pytest.approx(last)
    assert {r.seq for r in state.ring(df, 2).collect()} == {8, 9}
    snaps = spark.createDataFrame([("u", 0, "a"), ("u", 1, "b"), ("u", 2, "b"), ("v", 0, "b")], "key string, n int, fp string")
    assert [(r.key, r.n) for r in state.stable_snapshots(snaps, "key", ["n"], "fp").collect()] == [("u", 2)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i % 3, 1e9 + i * 7, i, i % 11 == 0) for i in range(200)]
    df = spark.createDataFrame(rows, "key long, ts double, seq long, limited boolean").withColumn("at", F.timestamp_seconds("ts"))
    want = {}
    for r in state.rate_fold(df).orderBy("key", "ts").collect():
        want[r.key] = round(r.delay, 9)
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = state.rate_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("rates").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination()
    assert {r.key: round(r.delay, 9) for r in spark.sql("select * from rates").collect()} == want
    q = state.compaction_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "key", ["ts", "seq"], f"{tmp_path}/out", f"{tmp_path}/c2").start()
    q.awaitTermination()
    assert {r.key: r.seq for r in spark.read.parquet(f"{tmp_path}/out/v0").collect()} == {0: 198, 1: 199, 2: 197}
