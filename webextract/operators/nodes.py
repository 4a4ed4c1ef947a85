"""Set-based operators over node tables: cleaning, subtree sums, scores, ranking, refinement, titles.

Every operator works page by page through windows or joins on page_id; subtrees are intervals of node_id, and sums over them
are differences of running sums, so the cost is linear in the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..functions import urls as U
from ..plans import rules
from ..session import staged


def _by_page(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Joined by page_id through a shuffle at every size: nodes compress so well that tables which look small enough to be
    broadcast, by the bytes of their files, do not fit the driver's memory."""
    return left.join(right.hint("merge"), "page_id", how)


def _under(is_root: Column) -> Column:
    """Whether a node lies in the subtree of an earlier node, or of itself, for which ``is_root`` holds."""
    upto = W.partitionBy("page_id").orderBy("node_id").rowsBetween(W.unboundedPreceding, 0)
    return F.coalesce(F.max(F.when(is_root, F.col("last_desc"))).over(upto) >= F.col("node_id"), F.lit(False))


def is_stripped(kept_tags: Column | None = None) -> Column:
    """Nodes that cleaning removes: by tag, but for those that the host's rules keep, and by role."""
    strip = F.col("tag").isin(*rules.STRIP_TAGS)
    if kept_tags is not None:
        strip = strip & ~F.coalesce(F.array_contains(kept_tags, F.col("tag")), F.lit(False))
    return F.coalesce(strip | F.coalesce(F.col("attrs")["role"], F.lit("")).isin(*rules.STRIP_ROLES), F.lit(False))


def cleaned(nodes: DataFrame, kept_tags: Column | None = None) -> DataFrame:
    """Nodes without the subtrees of stripped tags and roles; ``kept_tags`` is an array column, as host rules have it."""
    return nodes.withColumn("gone", _under(is_stripped(kept_tags))).filter(~F.col("gone")).drop("gone")


def _totals(nodes: DataFrame, **sums: Column) -> DataFrame:
    """Elements with sums over the nodes below each.

    A node stands in the page's line at its place, and an element once more at its end; the sum over a subtree is the
    running sum at its end less that at its start. One shuffle by page serves the window and the grouping.
    """
    place = lambda pos, end: F.struct(F.col(pos).alias("pos"), F.lit(end).alias("end"))
    both = F.when(F.col("kind") == "element", F.array(place("node_id", 0), place("last_desc", 1))).otherwise(F.array(place("node_id", 0)))
    line = nodes.withColumn("at", F.explode(both))
    upto = W.partitionBy("page_id").orderBy("at.pos", "at.end").rowsBetween(W.unboundedPreceding, 0)
    for name, value in sums.items():
        line = line.withColumn(name, F.sum(F.when(F.col("at.end") == 0, value).otherwise(0)).over(upto))
    rest = [c for c in nodes.columns if c not in ("page_id", "node_id")]
    found = line.filter("kind = 'element'").groupBy("page_id", "node_id")
    return found.agg(*[F.first(c).alias(c) for c in rest], *[(F.max(n) - F.min(n)).alias(n) for n in sums])


def measured(nodes: DataFrame) -> DataFrame:
    """Elements with text_length, link_density, paragraph_points (over descendants), as the node's text would give them."""
    length, one = F.coalesce(F.length("txt"), F.lit(0)), F.when(F.col("txt").isNotNull(), 1).otherwise(0)
    slim = nodes.select("page_id", "node_id", "parent_id", "last_desc", "depth", "kind", "tag", "class_id", F.col("attrs")["role"].alias("role"), "txt")
    first = _totals(slim, chars=length, texts=one, commas=F.coalesce(T.comma_count(F.col("txt")), F.lit(0)))
    elements = first.withColumn("text_length", F.col("chars") + F.greatest(F.col("texts") - 1, F.lit(0))).drop("chars", "texts", "txt")
    # What an element gives to those around it, not to itself.
    own_links = F.when(F.col("tag") == "a", F.col("text_length")).otherwise(0)
    own_points = F.when(F.col("tag") == "p", T.paragraph_points(F.col("text_length"), F.col("commas"))).otherwise(F.lit(0.0))
    second = _totals(elements, links=own_links, points=own_points)
    density = F.when(F.col("text_length") > 0, F.col("links") / F.col("text_length")).otherwise(F.lit(0.0))
    return second.withColumn("link_density", density).withColumn("paragraph_points", F.col("points")).drop("links", "points", "commas")


def scored(elements: DataFrame) -> DataFrame:
    """Measured elements with their content score."""
    base = T.tag_score(F.col("tag")) + T.class_weight(F.col("class_id")) + F.col("paragraph_points")
    return elements.withColumn("score", F.when(F.col("link_density") > rules.LINK_DENSITY_LIMIT, base * (1 - F.col("link_density"))).otherwise(base).cast("double"))


def candidates(elements: DataFrame) -> DataFrame:
    """Scored elements that may hold the article, with ``rank``: best score first, then kind of candidate and place."""
    group = (
        F.when(F.col("tag") == "article", 0).when(F.col("tag") == "main", 1).when(F.col("role") == "main", 2)
        .when((F.col("tag") == "div") & (F.col("text_length") > rules.MIN_CANDIDATE_CHARS), 3)
        .when((F.col("tag") == "section") & (F.col("text_length") > rules.MIN_CANDIDATE_CHARS), 4)
    )
    chosen = elements.withColumn("kind_order", group).filter(F.col("kind_order").isNotNull() & ~T.is_unlikely(F.col("class_id")))
    order = W.partitionBy("page_id").orderBy(F.desc("score"), "kind_order", "node_id")
    return chosen.withColumn("rank", F.row_number().over(order))


def refined(ranked: DataFrame, rounds: int = 3) -> DataFrame:
    """(page_id, node_id, last_desc, score) of the top candidate, moved up to ``rounds`` times to a stronger one inside it."""
    fields = ("node_id", "last_desc", "score", "text_length", "link_density")
    slim = staged(ranked.select("page_id", "tag", "rank", *fields), "candidates")
    now = slim.filter("rank = 1").select("page_id", F.struct(*fields).alias("t"))
    for _ in range(rounds):
        c = _by_page(now, slim)
        low, length, density = F.greatest("t.score", F.lit(0.1)), F.greatest("t.text_length", F.lit(500)), F.greatest("t.link_density", F.lit(0.0))
        ratio = F.when((density > 0.06) & (F.col("link_density") < 0.03) & (F.col("text_length") < 0.4 * length), 0.3).otherwise(0.85)
        ratio = F.when((F.col("tag") == "article") & (F.col("link_density") < 0.7 * density), F.least(ratio, F.lit(0.65))).otherwise(ratio)
        fits = (F.col("node_id") > F.col("t.node_id")) & (F.col("node_id") <= F.col("t.last_desc")) & (F.col("text_length") >= rules.MIN_CANDIDATE_CHARS)
        fits = fits & (F.col("score") >= low * ratio) & (F.col("text_length") >= 0.5 * length) & ((F.col("link_density") <= 0.8 * density) | (F.col("link_density") <= 0.05))
        order = F.struct((-F.col("score")).alias("s"), "link_density", "text_length", "rank")
        now = c.groupBy("page_id").agg(F.coalesce(F.min_by(F.struct(*fields), F.when(fits, order)), F.first("t")).alias("t"))
    return now.select("page_id", "t.node_id", "t.last_desc", "t.score")


def chosen(elements: DataFrame) -> DataFrame:
    """(page_id, node_id, last_desc, score) of the node that holds the article: the refined top candidate, or the first body
    of pages without candidates."""
    elements = staged(elements, "elements")
    top = refined(candidates(elements))
    body = F.min_by(F.struct("node_id", "last_desc", "score"), F.when(F.col("tag") == "body", F.col("node_id"))).alias("b")
    bodies = elements.groupBy("page_id").agg(body).filter(F.col("b").isNotNull())
    found = _by_page(bodies, top.select("page_id", F.struct("node_id", "last_desc", "score").alias("t")), "left")
    return found.select("page_id", F.coalesce("t", "b").alias("n")).select("page_id", "n.*")


def select_tags(nodes: DataFrame, tags: list[str], root: Column | None = None) -> DataFrame:
    """(page_id, place, node_id, tag) of the elements with one of ``tags``: by tag in the order given, then in document order;
    those for which ``root`` holds come last."""
    order = F.array_position(F.array(*map(F.lit, tags)), F.col("tag"))
    last = F.coalesce(root, F.lit(False)) if root is not None else F.lit(False)
    found = nodes.filter(F.col("tag").isin(*tags)).select("page_id", "node_id", "tag", order.alias("o"), last.alias("l"))
    return found.select("page_id", F.row_number().over(W.partitionBy("page_id").orderBy("l", "o", "node_id")).alias("place"), "node_id", "tag")


def subtree_text(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(page_id, text) of each root (page_id, node_id, last_desc): texts of the subtree joined by one space."""
    r = roots.select("page_id", F.col("node_id").alias("root"), F.col("last_desc").alias("upto"))
    inside = _by_page(nodes.filter(F.col("txt").isNotNull()), r).filter((F.col("node_id") > F.col("root")) & (F.col("node_id") <= F.col("upto")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "txt"))), lambda x: x["txt"]), " ")
    return _by_page(r.select("page_id"), inside.groupBy("page_id").agg(text.alias("text")), "left").select("page_id", F.coalesce("text", F.lit("")).alias("text"))


def titles(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, title): og:title, the first h1, <title> up to " - ", the URL's last part, or Untitled. Give cleaned nodes."""
    page = W.partitionBy("page_id")
    first = lambda is_it, *c: F.min(F.when(is_it, F.struct("node_id", *c))).over(page)
    marked = nodes.select(
        "page_id", "node_id", "txt",
        first((F.col("tag") == "meta") & (F.col("attrs")["property"] == "og:title"), F.col("attrs")["content"].alias("content")).alias("meta"),
        first(F.col("tag") == "h1", "last_desc").alias("h1"), first(F.col("tag") == "title", "last_desc").alias("title"),
    )
    inside = lambda n: (F.col("node_id") > F.col(f"{n}.node_id")) & (F.col("node_id") <= F.col(f"{n}.last_desc"))
    words = lambda n: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(inside(n) & F.col("txt").isNotNull(), F.struct("node_id", "txt")))), lambda x: x["txt"]), " ").alias(n)
    found = marked.groupBy("page_id").agg(F.first("meta.content").alias("content"), words("h1"), words("title"))
    some = lambda c: F.nullif(c, F.lit(""))
    t = pages.select("page_id", "url").join(found, "page_id", "left")
    return t.select("page_id", F.coalesce(some(F.col("content")), some(F.col("h1")), some(F.trim(F.substring_index("title", " - ", 1))), some(U.title_from_url(F.col("url"))), F.lit("Untitled")).alias("title"))


def links(nodes: DataFrame, only_a: bool = True) -> DataFrame:
    """(page_id, node_id, href) of elements with an href, in document order by node_id."""
    found = nodes.filter(F.coalesce(F.col("attrs")["href"], F.lit("")) != "")
    return (found.filter("tag = 'a'") if only_a else found).select("page_id", "node_id", F.col("attrs")["href"].alias("href"))
