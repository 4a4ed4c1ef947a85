"""HTML pages as node tables.

A node row has its place in document order, its parent and the last of its descendants, so a subtree is an interval. Trees
are built from the standard library's tokenizer: missing html, head and body are supplied, paragraphs, list items, table
cells and options end where the next one starts, stray end tags are skipped, and formatting left open goes on in the next
block, of like elements three at most.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

NODE_SCHEMA = (
    "page_id long, node_id int, parent_id int, last_desc int, depth int, kind string, tag string, class_id string, "
    "attrs map<string,string>, txt string"
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD = frozenset("title meta link style script base noscript template".split())
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr main menu nav ol p pre section table ul".split()
)
FORMATTING = frozenset("b i em strong u s small big tt code font strike".split())
#: A start tag ends an open element of its group, unless one of the stops lies between.
GROUPS = {
    "li": (("li",), ("ul", "ol", "menu")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")),
    "tbody": (("tbody", "thead", "tr", "td", "th"), ("table",)), "thead": (("tbody", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select",)),
}
BARRIERS = frozenset(("table", "td", "th", "button", "object", "template", "html"))


class Node:
    """An element, or text where ``tag`` is None."""

    __slots__ = ("tag", "attrs", "text", "parent", "children", "order")

    def __init__(self, tag: str | None, attrs: dict[str, str] | None = None, text: str = ""):
        self.tag, self.attrs, self.text = tag, attrs or {}, text
        self.parent: Node | None = None
        self.children: list[Node] = []
        self.order = -1

    def append(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    @staticmethod
    def remove_all(nodes: Iterable[Node]) -> None:
        """Remove many nodes; a parent's list is made anew once."""
        gone = set(nodes)
        for parent in {n.parent for n in gone if n.parent is not None}:
            parent.children = [c for c in parent.children if c not in gone]
        for n in gone:
            n.parent = None

    def walk(self) -> Iterator[Node]:
        """Strict descendants in document order."""
        todo = list(reversed(self.children))
        while todo:
            n = todo.pop()
            yield n
            todo.extend(reversed(n.children))

    def elements(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag is not None and (not tags or n.tag in tags)]

    def string(self) -> str:
        """Stripped texts joined by one space."""
        if self.tag is None:
            return self.text.strip()
        return " ".join(t for n in self.walk() if n.tag is None and (t := n.text.strip()))

    @property
    def class_id(self) -> str:
        return f"{self.attrs.get('class') or ''} {self.attrs.get('id') or ''}"


#: Like formatting elements (tag and attributes) that go on in the next block, at most.
LIKE_FORMATTING = 3


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.html = self.root.append(Node("html"))
        self.head = self.html.append(Node("head"))
        self.body: Node | None = None
        self.open: list[Node] = [self.html, self.head]
        self.tags = Counter(n.tag for n in self.open)  # of open elements
        self.again: list[Node] = []

    def _start_body(self) -> None:
        if self.body is None:
            self.body = self.html.append(Node("body"))
            self.open = [self.html, self.body]
            self.tags = Counter(n.tag for n in self.open)

    def _push(self, node: Node) -> None:
        self.open.append(node)
        self.tags[node.tag] += 1

    def _pop_to(self, i: int, explicit: bool = True) -> None:
        """Close all elements from position ``i`` on; formatting closed by the way is opened again later."""
        again = [n for n in self.open[i + explicit :] if n.tag in FORMATTING]
        for n in self.open[i:]:
            self.tags[n.tag] -= 1
        del self.open[i:]
        if again:
            like, kept = Counter(), []
            for n in reversed(self.again + again):  # the last ones of a kind
                kind = (n.tag, tuple(sorted(n.attrs.items())))
                like[kind] += 1
                if like[kind] <= LIKE_FORMATTING:
                    kept.append(n)
            self.again = kept[::-1]

    def _find(self, tags: tuple[str, ...], stops=BARRIERS) -> int:
        if not any(self.tags[t] for t in tags):
            return 0
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                return i
            if self.open[i].tag in stops:
                return 0
        return 0

    def _reopen(self) -> None:
        again, self.again = self.again, []
        for n in again:
            self._push(self.open[-1].append(Node(n.tag, dict(n.attrs))))

    def handle_starttag(self, tag, attrs):
        a = {}
        for k, v in attrs:
            a.setdefault(k, v or "")
        if tag in ("html", "head", "body"):
            if tag == "body":
                self._start_body()
            for k, v in a.items():
                {"html": self.html, "head": self.head, "body": self.body}[tag].attrs.setdefault(k, v)
            return
        if self.body is None and tag not in HEAD:
            self._start_body()
        if tag in ENDS_P and (i := self._find(("p",))):
            self._pop_to(i)
        if tag in GROUPS:
            members, stops = GROUPS[tag]
            if i := self._find(members, frozenset(stops) | {"html"}):
                self._pop_to(i)
                while tag in ("tr", "tbody", "thead") and (i := self._find(members, frozenset(stops) | {"html"})):
                    self._pop_to(i)
        if self.body is not None and tag not in ENDS_P and tag not in GROUPS and tag not in HEAD and self.again:
            self._reopen()
        node = self.open[-1].append(Node(tag, a))
        if tag not in VOID:
            self._push(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "path", "circle", "rect", "g", "use", "line", "polygon") and self.open[-1].tag == tag:
            self.tags[self.open.pop().tag] -= 1

    def handle_endtag(self, tag):
        if tag == "head":
            self._start_body()
            return
        if tag in ("html", "body") or tag in VOID:
            return
        if tag in FORMATTING:
            for n in reversed(self.again):
                if n.tag == tag:
                    self.again.remove(n)
                    return
        stops = ("html",) if tag in BARRIERS else BARRIERS
        i = self._find((tag,), stops)
        if i:
            if tag in FORMATTING and any(n.tag in ENDS_P for n in self.open[i + 1 :]):
                return
            self._pop_to(i)
        elif tag == "p" and self.body is not None:
            self.open[-1].append(Node("p"))

    def handle_data(self, data):
        if self.body is None and self.open[-1] in (self.head, self.html):
            if not data.strip():
                return
            self._start_body()
        if self.again and data.strip():
            self._reopen()
        at = self.open[-1]
        if at.children and at.children[-1].tag is None:
            at.children[-1].text += data
        else:
            at.append(Node(None, text=data))

    def unknown_decl(self, data):
        pass


def parse(html: str) -> Node:
    """The document node of a page; nodes carry their place in document order, the document having 0."""
    b = _Builder()
    b.feed(html)
    b.close()
    b._start_body()
    b.root.order = 0
    for i, n in enumerate(b.root.walk(), 1):
        n.order = i
    return b.root


def node_rows(root: Node) -> list[tuple]:
    """(node_id, parent_id, last_desc, depth, kind, tag, class_id, attrs, txt) of all nodes in document order."""
    nodes = [root, *root.walk()]
    last, depth = [n.order for n in nodes], [0] * len(nodes)
    for n in nodes[1:]:
        depth[n.order] = depth[n.parent.order] + 1
    for n in reversed(nodes[1:]):
        last[n.parent.order] = max(last[n.parent.order], last[n.order])
    out = []
    for n in nodes:
        parent = n.parent.order if n.parent is not None else None
        if n.tag is None:
            out.append((n.order, parent, last[n.order], depth[n.order], "text", None, None, None, n.text.strip() or None))
        else:
            out.append((n.order, parent, last[n.order], depth[n.order], "element", n.tag, n.class_id, list(n.attrs.items()), None))
    return out


_ARROW = pa.schema([
    ("page_id", pa.int64()), ("node_id", pa.int32()), ("parent_id", pa.int32()), ("last_desc", pa.int32()), ("depth", pa.int32()),
    ("kind", pa.string()), ("tag", pa.string()), ("class_id", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("txt", pa.string()),
])


def parse_nodes(pages: DataFrame) -> DataFrame:
    """(page_id, html) -> node rows. Pages of null html, and those that cannot be parsed, have none; the pages stay in their
    partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for page, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [(page, *r) for r in node_rows(parse(html))]
                except Exception:  # whatever the tokenizer meets in a page; its article says so
                    continue
                if len(rows) > 20_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return spread(pages.filter(F.col("html").isNotNull()).select("page_id", "html")).mapInArrow(run, NODE_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def read_html_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of HTML: (url, html), the file's path being the url."""
    from ..functions.text import decoded

    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("url"), decoded(F.col("content")).alias("html"))


def page_of(spark: SparkSession, html: str, url: str = "") -> DataFrame:
    """One page given as a string."""
    return spark.createDataFrame([(0, url, html)], "page_id long, url string, html string")
