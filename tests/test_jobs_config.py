import json
import logging
import pathlib
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from webextract import queries
from webextract.__main__ import main
from webextract.operators import cache, crawl, discovery, fetch, hosts, jobs
from webextract.plans import config, observe, rules
from webextract.streaming import storage


def test_config(tmp_path):
    assert config.as_bool(" Yes ", False) and not config.as_bool("off", True) and config.as_bool("?", True)
    assert config.as_int("7", 1, 1, 10) == 7 and config.as_int("11", 1, 1, 10) == 1 and config.as_int(None, 3) == 3
    assert config.as_float("0.5", 1.0) == 0.5 and config.as_float("-1", 1.0, 0) == 1.0 and config.as_float("x", 2.0) == 2.0
    env = {"HTTPS_PROXY": "s", "all_proxy": "a", "NO_PROXY": "x, y,,x"}
    assert config.proxies(env) == {"http": "a", "https": "s"} and config.proxies(env, "g") == {"http": "g", "https": "g"}
    assert config.bypass_list(env, "z,y") == ["z", "y", "x"]
    config.check_output_dir(f"{tmp_path}/new/one")
    (tmp_path / "file").write_text("")
    with pytest.raises(ValueError):
        config.check_output_dir(f"{tmp_path}/file")
    with pytest.raises(ValueError):
        config.check_output_dir(f"{tmp_path}/none", create=False)
    assert config.has_space(str(tmp_path), 0) and config.has_space("/no/such/place")
    assert config.as_level("warn") == "WARNING" and config.as_level("10") == "DEBUG" and config.as_level("?") == "INFO" and config.as_level(None, "ERROR") == "ERROR"
    assert config.as_format(" TEXT ") == "text" and config.as_format("xml") == "json"
    config.purge(f"{tmp_path}/new")
    assert list((tmp_path / "new").iterdir()) == []


def test_archives(tmp_path):
    with zipfile.ZipFile(f"{tmp_path}/a.whl", "w") as z:
        for n in ("webextract/x.py", "webextract/y.SO", "webextract-1.dist-info/METADATA", "sitecustomize.py", "other/z.py"):
            z.writestr(n, "")
    assert config.check_archive(f"{tmp_path}/a.whl") == ["banned file suffix: webextract/y.SO", "banned file name: sitecustomize.py", "unexpected top-level entry: other/z.py"]
    with tarfile.open(f"{tmp_path}/a.tar.gz", "w:gz") as t:
        for n in ("x.py", "run.bat"):
            (tmp_path / n).write_text("")
            t.add(tmp_path / n, f"a-1/{n}")
    assert config.check_archive(f"{tmp_path}/a.tar.gz") == ["banned file suffix: run.bat"]
    assert config.check_archive("a.rpm") == ["unsupported distribution type: a.rpm"]


def test_log_lines():
    r = logging.makeLogRecord({"msg": "said %s", "args": ("x",), "levelname": "INFO", "name": "n", "component": "cli", "url": "u", "odd": 1, "created": 0.0})
    assert json.loads(observe.JsonFormatter().format(r)) == {"timestamp": "1970-01-01T00:00:00+00:00", "level": "INFO", "component": "cli", "message": "said x", "logger": "n", "url": "u", "odd": 1}
    assert observe.TextFormatter().format(r) == "1970-01-01 00:00:00 INFO cli said x | url=u"
    logger = observe.setup_logs("server", style="text")
    assert len(observe.setup_logs("server").handlers) == 1 and not logger.propagate


def test_fetch(spark):
    waits, calls = [], []

    def answer(url):
        calls.append(url)
        if url == "bad" or len(calls) < 2:
            raise OSError("down")
        return "html", 500 if len(calls) < 3 else 200

    assert fetch.fetch_once(answer, "u", sleep=waits.append) == ("html", 200, None, 3) and waits == pytest.approx([0.3, 0.6])
    assert fetch.fetch_once(answer, "bad", sleep=waits.append) == (None, None, "down", 3)
    assert fetch.fetch_once(lambda u: ("x", 404), "u", sleep=waits.append) == ("x", 404, None, 1)
    assert fetch.fetch_once(lambda u: ("x", 503), "u", sleep=waits.append) == ("x", 503, None, 3)
    assert fetch.choose_fetcher(["http"]) == "http" and fetch.choose_fetcher(["http", "browser"]) == "browser" and fetch.choose_fetcher(["http", "browser"], False) == "http"
    with pytest.raises(ImportError):
        fetch.choose_fetcher([])
    wanted = spark.createDataFrame([("H/a#x", 1), ("http://h/b", 2), (None, 3)], "url string, n int")
    got = {r.n: r for r in fetch.from_snapshot(wanted, spark.createDataFrame([("http://h/a", "A")], "url string, html string")).collect()}
    assert (got[1].html, got[1].status, got[1].error) == ("A", 200, None) and got[2].error == "Not in snapshot: http://h/b" and got[3].html is None
    s = spark.createDataFrame([(None, True), (301, None), (200, False)], "status int, seen boolean").select(fetch.browser_status(F.col("status"), F.col("seen")).alias("s"))
    assert [r.s for r in s.collect()] == [200, 301, 408]


def crawl_one_by_one(start, http, config, recent=(), browser=None):
    """The queue of one worker, URL by URL."""
    queue, log, visited, scheduled, used = [], [], set(), set(), {}
    for u in sorted(start):
        if u not in scheduled:
            queue.append(u)
            scheduled.add(u)
    collected = 0
    while queue:
        u = queue.pop(0)
        if config.max_pages is not None and collected >= config.max_pages:
            break
        if u in recent:
            outcome = "skipped"
        else:
            outcome, html, limited = "failed", None, False
            first = browser is not None and config.prefer_browser
            if first:
                status, page = browser.get(u, (None, None))
                outcome, html = ("limited", None) if status == 429 else ("success", page) if page is not None else ("failed", None)
            if not first or outcome == "failed" and u not in (browser or {}):
                for _ in range(1 if first else config.max_retries):
                    n = used.get(u, 0)
                    if n >= len(http.get(u, ())):
                        break
                    used[u] = n + 1
                    status, page = http[u][n]
                    limited |= status == 429
                    if 0 < status < 400:
                        outcome, html = "success", page
                    if 0 < status < 400 or status in (404, 410, -1):
                        break
                if outcome == "failed" and limited:
                    outcome = "limited"
                if outcome == "failed" and browser is not None and not first and u in browser:
                    status, page = browser[u]
                    outcome, html = ("limited", None) if status == 429 else ("success", page)
        log.append((u, outcome))
        if outcome in ("success", "skipped"):
            collected += 1
            visited.add(u)
        if outcome == "success":
            for x in html:
                if x not in visited and x not in scheduled:
                    queue.append(x)
                    scheduled.add(x)
        if outcome == "limited":
            queue.append(u)
        else:
            scheduled.discard(u)
    return log


@pytest.mark.parametrize("seed", range(6))
def test_discovery_is_the_queue_of_one_worker(spark, seed):
    import random

    rng = random.Random(seed)
    url = lambda i: f"https://h/{i:02d}"
    links = {url(i): list(dict.fromkeys(url(rng.randrange(30)) for _ in range(rng.randrange(5)))) for i in range(28)}
    http = {u: [(rng.choice([429, 429, 503, 0, 500]), []) for _ in range(rng.randrange(3))] + [(rng.choice([200, 200, 200, 200, 404, -1]), x)] for u, x in links.items()}
    config = discovery.DiscoveryConfig(max_pages=[None, 9][seed % 2], max_retries=1 + seed % 3, prefer_browser=seed % 3 == 0)
    browser = {u: (rng.choice([200, 500]), x) for u, x in links.items() if rng.random() < 0.5} if seed >= 2 else None
    recent = {url(3), url(7)} if seed != 4 else set()
    start = [url(0), url(5), url(0)]
    page = lambda x: "".join(f"<a href='{u}#f'>x</a>" for u in x) or "<p>"
    answers = spark.createDataFrame([(u, n + 1, s, page(x)) for u, a in http.items() for n, (s, x) in enumerate(a)], "url string, attempt int, status int, html string")
    second = spark.createDataFrame([(u, s, page(x)) for u, (s, x) in browser.items()], "url string, status int, html string") if browser else None
    known = spark.createDataFrame([(u,) for u in recent], "url string") if recent else None
    found = discovery.discover(spark, spark.createDataFrame([(u,) for u in start], "url string"), answers, config, browser=second, recent=known)
    got = [(r.url, r.outcome) for r in found.log.orderBy("round", "seq").collect()]
    assert got == crawl_one_by_one(start, http, config, recent, browser)
    assert {r.url for r in found.urls.collect()} == {u for u, o in got if o in ("success", "skipped")}


def test_discovery_of_nothing(spark):
    none = spark.createDataFrame([], "url string")
    found = discovery.discover(spark, none, spark.createDataFrame([], "url string, html string"))
    assert found.urls.collect() == [] and found.log.collect() == [] and found.found.collect() == []


def test_cache_and_storage(spark, tmp_path):
    c = cache.ResponseCache(spark, capacity=2)
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    put = lambda *kv: c.store(spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(kv)], "key string, answer string, place int"))
    put(("a", "1"), ("b", "2"), ("a", "3"))
    assert {r.key: (r.answer, r.hit) for r in c.lookup(keys("a", "x")).collect()} == {"a": ("3", True), "x": (None, False)}
    put(("c", None))  # b was used longest ago
    assert {r.key: r.hit for r in c.lookup(keys("a", "b", "c")).collect()} == {"a": True, "b": False, "c": False} and c.size() == 2
    c.clear()
    assert c.size() == 0
    log_ = storage.StorageLog(spark, f"{tmp_path}/log", most_pending=2, most_age=50.0, retention=100.0)
    add = lambda *rows: log_.append(spark.createDataFrame(rows, "store string, payload string, change_id string, created_at double"))
    add(("s", "old", "1", 10.0), ("s", "new", "3", 20.0), ("s", "mid", "2", 20.0), ("t", "x", "4", 5.0))
    stats = {r.store: (r.pending, r.oldest_age, r.newest_id, r.too_many, r.too_old) for r in log_.merge(60.0).collect()}
    assert stats == {"s": (3, 50.0, "3", True, False), "t": (1, 55.0, "4", False, True)}
    assert {r.store: bytes(r.payload) for r in log_.state.collect()} == {"s": b"new", "t": b"x"} and log_.processed.count() == 4
    add(("t", "y", "5", 100.0))
    assert log_.stats(170.0).first().pending == 1
    log_.merge(170.0)
    assert {r.store: bytes(r.payload) for r in log_.state.collect()} == {"s": b"new", "t": b"y"} and [r.change_id for r in log_.processed.collect()] == ["5"]
    assert log_.merge(171.0).collect() == [] and log_.state.count() == 2
    assert spark.createDataFrame([("{x",)], "t string").select(storage.canonical_document(F.col("t")).alias("d")).first().d is None


def test_host_rules_table(spark):
    p = spark.createDataFrame([("https://www.InfoWorld.com/a",), ("https://x.org/",)], "url string")
    got = {r.url: r for r in hosts.with_rules(p, hosts.host_rules(spark)).withColumn("strip", hosts.stripped_tags(F.col("kept_tags"))).collect()}
    a, b = got["https://www.InfoWorld.com/a"], got["https://x.org/"]
    assert tuple(a.kept_tags) == rules.KEPT_TAGS["infoworld.com"] and a.keeps_boilerplate and "nav" not in a.strip and tuple(b.strip) == rules.STRIP_TAGS and not b.keeps_boilerplate


def test_links_on_seed_hosts(spark):
    u = spark.createDataFrame([("https://H/a",), ("ftp://h/b",), ("http://h/c",), ("x",)], "url string")
    assert {r.url[-1]: r.same_host for r in crawl.on_seed_hosts(u, spark.createDataFrame([("http://h/",)], "url string")).collect()} == {"a": False, "b": False, "c": True, "x": False}


def test_jobs(spark):
    j = spark.createDataFrame([(1,), (2,), (3,)], "job_id int")
    e = spark.createDataFrame([(1, 0, "running"), (1, 1, "completed"), (2, 5, "running"), (2, 6, "odd"), (9, 0, "failed")], "job_id int, at int, status string")
    states = jobs.job_states(j, e)
    assert {r.job_id: r.status for r in states.collect()} == {1: "completed", 2: "running", 3: "queued"}
    assert jobs.can_start(states, 1).first().can_start is False and jobs.can_start(states, 2).first().can_start is True
    f = spark.createDataFrame([("a", 429), ("b", 429), ("b", 200), ("c", 500)], "url string, status int")
    assert [r.url for r in jobs.requeued(f).collect()] == ["a"]


def test_can_start_query_uses_the_operator(spark, monkeypatch):
    calls, own = [], jobs.can_start
    monkeypatch.setattr(jobs, "can_start", lambda *a: calls.append(a[1]) or own(*a))
    row = queries.QUERIES["a18_can_start"](spark, "/root/testdata/sf0.001").first()
    assert calls == [3] and row.can_start == (row.running < 3)


def test_ordered_seeds(spark):
    urls = [f"http://h/{i * 7919 % 5000}" for i in range(6000)]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = jobs.ordered_seeds(spark.createDataFrame([(u,) for u in [*urls, None]], "url string").repartition(5))
        assert [tuple(r) for r in got.orderBy("seq").collect()] == [(u, i) for i, u in enumerate(sorted(set(urls)), 1)]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert "SinglePartition" not in got._jdf.queryExecution().toString() and jobs.ordered_seeds(got.limit(0)).collect() == []


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "p.html").write_text("<title>T</title><article><p>" + "Words of text. " * 60 + "</p></article>")
    assert main(["extract", "--file", f"{tmp_path}/p.html", "-o", "text"]) == 0
    assert "Title: T" in capsys.readouterr().out
    pages = [(0, "http://h/a", "<a href=/b>x</a><article><p>first page text</p></article>"), (1, "http://h/b", "<article><p>second</p></article>"), (2, "http://h/c", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/snap/pages.parquet")
    assert main(["crawl", "--snapshot", f"{tmp_path}/snap", "--seed", "http://h/a", "--output-dir", f"{tmp_path}/out"]) == 0
    assert sorted(x.name for x in (tmp_path / "out").glob("*.md")) == ["h__a.md", "h__b.md"]
    said = json.loads((tmp_path / "out/manifest.json").read_text())
    assert [r["url"] for r in said["results"]] == ["http://h/a", "http://h/b"] and said["duration_seconds"] > 0 and said["started_at"] < said["completed_at"]
    maps = [("s.xml", "<urlset><loc>http://h/c</loc><loc>http://h/b</loc></urlset>", 200)]
    spark.createDataFrame(maps, "source string, xml string, status int").write.parquet(f"{tmp_path}/snap/sitemaps.parquet")
    more = ["crawl", "--snapshot", f"{tmp_path}/snap", "--sitemap", "s.xml", "--no-follow-links", "--rate-limit", "0.5", "--workers", "2", "--output-dir", f"{tmp_path}/out2"]
    assert main(more) == 0
    said = json.loads((tmp_path / "out2/manifest.json").read_text())
    assert [r["status"] for r in said["results"]] == ["skipped", "success"] and said["config"]["rate_limit_delay"] == 0.5 and not said["config"]["follow_links"]
    assert main([*more[:-1], f"{tmp_path}/p.html"]) == 1
    with pytest.raises(SystemExit):
        main(["crawl", "--snapshot", "x", "--output-dir", "y"])
    assert not list(pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).glob("webextract/results-*"))  # what a command stages goes


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert o.keys() <= q.keys() and len(q) > 70
