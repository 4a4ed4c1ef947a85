import json
import os
import pathlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webextract.operators import article, nodes
from webextract.plans import rules
from webextract.session import staged
from webextract.sources import html as H

PAGES = {
    "tables": "<title>T - Site</title><div id=a class=content><table><tr><td>" + "x, y " * 150 + "<tr><td>b</table></div>",
    "nested": "<div><div class='sidebar'>" + "s " * 400 + "</div><div class=post><p>" + "word, " * 200 + "<p>" + "more " * 50 + "<a href=/x>link text</a></div></div>",
    "article": "<header><h1>Gone</h1></header><title>Kept - Site</title><article><h1>H &amp; t</h1><p>" + "Text, text. " * 30 + "</p></article>",
    "refined": "<article class=page>" + "<a href=q>menu entry</a> " * 40 + "<article class='post'><p>" + "Long, long text here. " * 120 + "</p></article></article>",
    "links": "<main>" + "<p><a href='z'>" + "linked words " * 30 + "</a></p>" * 3 + "</main><section>" + "plain " * 120 + "</section>",
    "empty": "", "text": "only text", "roles": "<div role=navigation>nav</div><div role=main><p>" + "Main, text " * 60 + "</div>",
    "unclosed": "<ul><li>a<li>b<ul><li>c</ul><li>d</ul><p>one<b>bold<p>two</b> three<div>four",
}


def frame(spark):
    rows = [(i, f"https://example.com/some-page_{i}", h) for i, h in enumerate(PAGES.values())]
    rows += [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select(F.col("page_id") + 100, "url", "html").collect()]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), rows


def test_set_based_equals_tree(spark):
    df, rows = frame(spark)
    clean = nodes.cleaned(H.parse_nodes(df))
    scored = nodes.scored(nodes.measured(clean))
    got = {(r.page_id, r.node_id): (r.text_length, round(r.link_density, 9), round(r.score, 6)) for r in scored.collect()}
    tops = {r.page_id: r.node_id for r in nodes.refined(nodes.candidates(scored)).collect()}
    titles = {r.page_id: r.title for r in nodes.titles(clean, df).collect()}
    texts = {r.page_id: r.text for r in nodes.subtree_text(clean, nodes.refined(nodes.candidates(scored))).collect()}
    want = {}
    for page, url, html in rows:
        root = H.parse(html)
        article.clean(root, "")
        m = article.Measures(root)
        for n in [root, *root.elements()]:
            assert m.length(n) == len(n.string())
            links = sum(len(a.string()) for a in n.elements("a"))
            assert m.density(n) == (links / len(n.string()) if n.string() else 0)
            want[page, n.order] = (m.length(n), round(m.density(n), 9), round(m.score(n), 6))
        ranked = article.ranked_candidates(root, m)
        assert (page in tops) == bool(ranked)
        if ranked:
            top = article.top_candidate(root, m)
            assert tops[page] == top.order and texts[page] == top.string()
        assert titles[page] == article.title_of(root, url)
    assert got == want


def test_node_tables_are_not_broadcast(spark):
    """However small their files are: staged nodes inflate to many times that."""
    df, rows = frame(spark)
    clean = staged(nodes.cleaned(H.parse_nodes(df)), "nodes")
    got = nodes.subtree_text(clean, nodes.chosen(nodes.scored(nodes.measured(clean))))
    assert got.count() == len([1 for _, _, html in rows if html is not None])
    got.collect()
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


tree = st.recursive(st.text(alphabet="ab, .", max_size=30), lambda c: st.tuples(st.sampled_from(["div", "p", "a", "nav", "span", "li", "b"]), st.lists(c, max_size=4)), max_leaves=25)


def render(t):
    return t if isinstance(t, str) else f"<{t[0]}>{''.join(map(render, t[1]))}</{t[0]}>"


@settings(max_examples=150, deadline=None)
@given(st.lists(tree, max_size=4))
def test_node_rows_are_a_tree(parts):
    root = H.parse("".join(map(render, parts)))
    rows = H.node_rows(root)
    assert [r[0] for r in rows] == list(range(len(rows)))
    for i, parent, last, depth, *_ in rows:
        below = {j for j, p, *_ in rows if p is not None and (p == i or any(j2 == p and i < j2 <= last for j2, *_ in rows))}
        assert all(i < j <= last for j in below) and depth == (rows[parent][3] + 1 if parent is not None else 0)


def test_tree_rules():
    root = H.parse(PAGES["unclosed"])
    ul = root.elements("ul")[0]
    assert [n.tag for n in ul.children] == ["li"] * 3 and len(ul.children[1].elements("li")) == 1
    assert [p.string() for p in root.elements("p")] == ["one bold", "two three"]
    assert [b.string() for b in root.elements("b")] == ["bold", "two"]
    assert root.elements("div")[0].parent.tag == "body"
    page = H.parse("<script>var t = '</p><h1>x</h1>'</script><p>a&nbsp;b</p>")
    assert page.elements("h1") == [] and page.elements("p")[0].string() == "a\xa0b"


def test_article_fields():
    html = "<html><head><meta property='og:title' content='OG'></head><body><nav><a href=/n>n</a></nav><article><h1>Head</h1><p>" + "Some words here. " * 30 + "</p><a href='javascript:x()'>bad</a><a href=''></a><img src='t.gif'><img src='/i/photo.png' srcset='a.png 1x, /b.png 2x'><p></p><pre>x  y</pre><ul><li>one<li><b>two</b></ul></article></body></html>"
    got = article.extract(html, "https://example.com/d/p.html")
    assert got["success"] and got["title"] == "OG" and got["warnings"] == [] and got["excerpt"].endswith("...")
    assert 'src="https://example.com/i/photo.png"' in got["content"] and "https://example.com/d/a.png 1x, https://example.com/b.png 2x" in got["content"]
    assert "t.gif" not in got["content"] and "javascript" not in got["content"] and "<nav" not in got["content"]
    assert "# Head" in got["markdown"] and "- one\n- **two**" in got["markdown"] and "```\nx  y\n```" in got["markdown"]
    short = article.extract("<article><p>few</p></article>")
    assert short["success"] and short["warnings"] == ["Content below minimum word count (1 < 50)"] and short["title"] == "Untitled"
    assert article.extract("caf\xe9 <p>".encode("latin-1"))["content"].count("caf\xe9") == 1
    assert "Privacy" not in article.extract("<article><p>" + "Real text, here. " * 60 + "</p><div class='newsletter'>Privacy policy and terms of use</div></article>")["content"]


@pytest.mark.parametrize(("host", "html", "want"), [
    ("jsomers.net", "<article>" + "x " * 400 + "<div class='postContent'>inner</div></article>", "inner"),
    ("www.thelocal.dk", "<article>" + "x " * 400 + "<div id=articleBody>body text</div></article>", "body text"),
    ("infoworld.com", "<div id=page><aside>kept</aside><article>" + "x " * 300 + "</article><div class=ad>ad</div></div>", "kept " + ("x " * 300).strip()),
])
def test_host_rules(host, html, want):
    content = article.extract(html, f"https://{host}/a")["content"]
    assert H.parse(content).elements("body")[0].string() == want


@pytest.mark.parametrize("html", [
    "<div>" * 10_000 + "word, " * 300, "<p><b>text of it" * 10_000, "<article>" + "<span>" * 10_000 + "word " * 300, "<ul><li>x " * 5_000, "<blockquote><p>text " * 5_000,
    "<article>" + "<a href=x>privacy policy</a> " * 5_000, "<div class=share>" * 3_000 + "<a href=q>privacy policy</a> " * 3_000, "<div><p>x</p></div>" * 10_000,
], ids=["nested", "open", "spans", "lists", "quotes", "links", "hints", "siblings"])
def test_degenerate_pages(html):
    """No page breaks the extraction or takes more than its share of time."""
    began = time.time()
    got = article.extract(html, "https://example.com/a")
    assert got["error"] is None and got["success"]
    assert len(H.node_rows(H.parse(html))) < 100_000 and time.time() - began < 20
    assert len(got["content"]) < 20 * len(html) + 1_000_000


def test_formatting_goes_on_three_times():
    root = H.parse("<p><b>t" * 50)
    assert max(len([1 for x in p.walk() if x.tag == "b"]) for p in root.elements("p")) == 4
    assert [p.string() for p in root.elements("p")] == ["t"] * 50


def naive_sanitize(node, boilerplate=True):
    """The steps one by one, each measured on the tree as it is."""
    content = lambda n: bool(n.string()) or any(article.is_image_source(i.attrs.get("src")) for i in n.elements("img"))
    inside = lambda n: n is node or (n.parent is not None and inside(n.parent))
    for n in node.elements("a"):
        if not content(n):
            n.remove()
    for n in node.elements("img"):
        if not article.is_image_source(n.attrs.get("src")):
            n.remove()
    for tag in rules.BOILERPLATE_TAGS if boilerplate else ():
        for n in node.elements(tag):
            text = n.string()
            if not text or not inside(n):
                continue
            density, c, size = min(1.0, sum(len(a.string()) for a in n.elements("a")) / len(text)), n.class_id.strip().lower(), len(text)
            hint, strong = any(x in c for x in rules.BOILERPLATE_HINTS), any(x in c for x in rules.STRONG_HINTS)
            phrase = any(p in " ".join(text.lower().split()) for p in rules.BOILERPLATE_PHRASES)
            tests = ((strong, size < 5000 or density > 0.08), (hint, size < 2500 and density > 0.05), (article.is_unlikely(n.class_id), size < 1600 or density > 0.2), (phrase and hint, density > 0.08 or size < 1200), (phrase, density > 0.35), (phrase and strong, size < 2500))
            if any(a and b for a, b in tests):
                n.remove()
    for tag in ("li", "p", "div"):
        for n in node.elements(tag):
            if not content(n):
                n.remove()


block = st.recursive(
    st.sampled_from(["see", "also", "Privacy  ", " policy", "x" * 700, "word " * 300, "", "<img src=t.gif>", "<img src=/a/photo.png>", "<a href=/>", "<a href=/>link</a>"]),
    lambda c: st.tuples(st.sampled_from(["div", "p", "section", "ul", "li", "a", "span", "aside"]), st.sampled_from(["", " class=share", " id=comment", " class=body", " class='hidden'"]), st.lists(c, max_size=4)), max_leaves=20,
)


@settings(max_examples=200, deadline=None)
@given(st.lists(block, max_size=4))
def test_sanitize_equals_steps(parts):
    show = lambda t: t if isinstance(t, str) else f"<{t[0]}{t[1]}>{' '.join(map(show, t[2]))}</{t[0]}>"
    html = "".join(map(show, parts))
    a, b = H.parse(html), H.parse(html)
    article.sanitize(a)
    naive_sanitize(b)
    assert article.to_html(a, safe=False) == article.to_html(b, safe=False)


def test_statuses(spark):
    good, sparse = "<article><p>" + "Some words here. " * 60 + "</p></article>", "<p>gone</p>"
    rows = [(1, 200, good), (2, 404, good), (3, 410, sparse), (4, 403, good), (5, 500, good), (6, None, good), (7, 301, good), (8, 404, None), (9, 200, None)]
    df = spark.createDataFrame([(i, f"https://example.com/{i}", h, s) for i, s, h in rows], "page_id long, url string, html string, status int")
    got = {r.page_id: r for r in article.extract_articles(df, status_col="status").collect()}
    assert [got[i].success for i in range(1, 10)] == [True, True, False, False, False, True, True, False, False]
    assert got[2].warnings == ["Extracted after HTTP 404 (SPA/client-rendered)"] and got[1].warnings == []
    assert (got[3].error, got[4].error, got[8].error, got[9].error) == ("HTTP 410", "HTTP 403", "HTTP 404", "No HTML") and got[4].title == ""


CORPUS = sorted(pathlib.Path(os.environ["WEBEXTRACT_CORPUS"]).glob("*/*/meta.json")) if os.environ.get("WEBEXTRACT_CORPUS") else []


@pytest.mark.parametrize("meta", [m for m in CORPUS if all((m.parent / f"{x}.html").exists() for x in ("raw", "expected"))], ids=lambda m: m.parent.name)
def test_corpus(meta):
    """Text of whole pages in a folder of host/case/{meta.json, raw.html, expected.html}, where one is named."""
    text = lambda h: re.sub(r"\s+([,.;:!?])", r"\1", " ".join(H.parse(h).string().split()))
    got = article.extract((meta.parent / "raw.html").read_text(), json.loads(meta.read_text())["url"])
    assert got["success"] and text(got["content"]) == text((meta.parent / "expected.html").read_text())


def test_articles_of_a_stream(spark, tmp_path):
    df, rows = frame(spark)
    df.write.parquet(f"{tmp_path}/in")
    stream = article.extract_articles(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(rows)


def test_articles_frame(spark):
    df, rows = frame(spark)
    got = article.extract_articles(df.unionByName(spark.createDataFrame([(999, None, None)], df.schema)))
    assert got.count() == len(rows) + 1
    bad = got.filter("page_id = 999").first()
    assert not bad.success and bad.error == "No HTML"
    assert got.filter("page_id = 0").first().title == "T"
