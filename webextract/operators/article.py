"""Articles of pages in one pass: each page is parsed, scored, cleaned and rendered where its row lies, with no shuffle.

The rules are those of the set-based operators in ``nodes``; here they are worked out on the page's tree, whose subtree sums
are made bottom-up once.
"""

from __future__ import annotations

import html as html_module
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import absolute_srcset
from ..plans import rules
from ..session import spread
from ..sources.html import VOID, Node, parse

ARTICLE_SCHEMA = (
    "page_id long, url string, title string, content string, markdown string, excerpt string, word_count int, success boolean, "
    "error string, author string, date_published string, language string, warnings array<string>"
)


@dataclass(frozen=True)
class Options:
    """What an extraction may be asked for. ``images`` and ``code`` tell answers apart in a cache and change nothing else."""

    min_words: int = rules.MIN_WORDS
    safe_markdown: bool = True
    images: bool = True
    code: bool = True


def _pattern(parts) -> re.Pattern:
    return re.compile(rules.either(parts), re.IGNORECASE)


_UNLIKELY, _MAYBE, _POSITIVE, _NEGATIVE, _PHOTO = map(_pattern, (rules.UNLIKELY, rules.MAYBE, rules.POSITIVE, rules.NEGATIVE, rules.PHOTO))
_ASSET, _HINT, _STRONG = map(_pattern, ((rules.ASSET,), rules.BOILERPLATE_HINTS, rules.STRONG_HINTS))
_ARTIFACT = re.compile(rules.CSS_ARTIFACT, re.IGNORECASE | re.DOTALL)


def class_weight(class_id: str) -> int:
    if not class_id.strip():
        return 0
    pairs = ((_POSITIVE, rules.POSITIVE_WEIGHT), (_NEGATIVE, rules.NEGATIVE_WEIGHT), (_PHOTO, rules.PHOTO_WEIGHT), (_ASSET, rules.ASSET_WEIGHT))
    return sum(w for p, w in pairs if p.search(class_id))


def is_unlikely(class_id: str) -> bool:
    return bool(class_id.strip()) and bool(_UNLIKELY.search(class_id)) and not _MAYBE.search(class_id)


def select(root: Node, selector: str) -> list[Node]:
    """Descendants that match tag, .class, #id, tag.class, [a="v"], [a^="v"] or [a*="v"], in document order."""
    m = re.fullmatch(r"([a-z][a-z0-9]*)?(?:\.([\w-]+)|#([\w-]+)|\[([\w-]+)([\^*]?)=\"([^\"]*)\"\])?", selector)
    tag, cls, id_, attr, how, value = m.groups()

    def fits(n: Node) -> bool:
        if n.tag is None or (tag and n.tag != tag):
            return False
        if cls:
            return cls in n.attrs.get("class", "").split()
        if id_:
            return n.attrs.get("id") == id_
        if attr:
            have = n.attrs.get(attr)
            return have is not None and (have.startswith(value) if how == "^" else value in have if how == "*" else have == value)
        return True

    return [n for n in root.walk() if fits(n)]


def host_of(url: str) -> str:
    try:
        host = urlsplit(url).netloc.lower()
    except ValueError:
        return ""
    return host[4:] if host.startswith("www.") else host


def clean(root: Node, host: str) -> None:
    """Remove what is no content: tags (for some hosts fewer) and roles."""
    kept = rules.KEPT_TAGS.get(host, ())
    Node.remove_all(n for n in root.elements() if (n.tag in rules.STRIP_TAGS and n.tag not in kept) or n.attrs.get("role") in rules.STRIP_ROLES)


class Measures:
    """Text length, links, commas and paragraph points of every element, bottom-up."""

    def __init__(self, root: Node):
        self.of: dict[Node, tuple[int, int, int, int, float]] = {}  # characters, texts, commas, link length, points
        self.last: dict[Node, int] = {}  # place of the last descendant
        for n in reversed([root, *root.walk()]):
            self.last[n] = self.last[n.children[-1]] if n.children else n.order
            if n.tag is None:
                t = n.text.strip()
                self.of[n] = (len(t), 1 if t else 0, t.count(","), 0, 0.0)
                continue
            chars = texts = commas = links = 0
            points = 0.0
            for c in n.children:
                a = self.of[c]
                chars, texts, commas, links, points = chars + a[0], texts + a[1], commas + a[2], links + a[3], points + a[4]
                if c.tag == "a":
                    links += self.length(c)
                elif c.tag == "p":
                    size = self.length(c)
                    points += 0.0 if size < rules.MIN_PARAGRAPH_CHARS else 1.0 + a[2] + min(size // 100, 3)
            self.of[n] = (chars, texts, commas, links, points)

    def length(self, n: Node) -> int:
        chars, texts = self.of[n][:2]
        return chars + max(texts - 1, 0)

    def density(self, n: Node) -> float:
        size = self.length(n)
        return self.of[n][3] / size if size else 0.0

    def is_inside(self, n: Node, top: Node) -> bool:
        """Whether a node is a strict descendant."""
        return top.order < n.order <= self.last[top]

    def score(self, n: Node) -> float:
        base = rules.TAG_SCORES.get(n.tag, 0) + class_weight(n.class_id) + self.of[n][4]
        d = self.density(n)
        return base * (1 - d) if d > rules.LINK_DENSITY_LIMIT else float(base)


def ranked_candidates(root: Node, m: Measures) -> list[Node]:
    """Candidates, best first."""
    groups = [root.elements("article"), root.elements("main"), [n for n in root.elements() if n.attrs.get("role") == "main"]]
    groups += [[n for n in root.elements(t) if m.length(n) > rules.MIN_CANDIDATE_CHARS] for t in ("div", "section")]
    seen = dict.fromkeys(n for g in groups for n in g if not is_unlikely(n.class_id))
    return sorted(seen, key=lambda n: -m.score(n))


def top_candidate(root: Node, m: Measures) -> Node | None:
    """The node that holds the article; the first body where there is no candidate."""
    ranked = ranked_candidates(root, m)
    if not ranked:
        return next(iter(root.elements("body")), None)
    best = ranked[0]
    for _ in range(3):
        score, length, density = max(m.score(best), 0.1), max(m.length(best), 500), max(m.density(best), 0.0)
        options = []
        for c in ranked:
            size, d = m.length(c), m.density(c)
            if c is best or size < rules.MIN_CANDIDATE_CHARS or not m.is_inside(c, best):
                continue
            ratio = 0.3 if density > 0.06 and d < 0.03 and size < 0.4 * length else 0.85
            if c.tag == "article" and d < 0.7 * density:
                ratio = min(ratio, 0.65)
            if m.score(c) >= score * ratio and size >= 0.5 * length and (d <= 0.8 * density or d <= 0.05):
                options.append((-m.score(c), d, size, len(options), c))
        if not options:
            break
        best = min(options)[-1]
    return best


def title_of(root: Node, url: str) -> str:
    """Title by the first source that has one."""
    meta = next((n for n in root.elements("meta") if n.attrs.get("property") == "og:title"), None)
    if meta is not None and meta.attrs.get("content"):
        return meta.attrs["content"]
    for tag in ("h1", "title"):
        n = next(iter(root.elements(tag)), None)
        text = n.string() if n is not None else ""
        if tag == "title":
            text = text.split(" - ")[0].strip()
        if text:
            return text
    try:
        path = urlsplit(url).path
    except ValueError:
        path = ""
    if path.strip("/"):
        return path.strip("/").split("/")[-1].replace("-", " ").replace("_", " ").title() or "Untitled"
    return "Untitled"


def moved(node: Node, host: str) -> Node:
    """The chosen node, adjusted for its host."""
    if host == "martinfowler.com":
        return node.parent if "paperBody" in node.attrs.get("class", "") and node.parent is not None else node
    if host == "infoworld.com":
        at: Node | None = node
        while at is not None:
            if at.attrs.get("id") == "page":
                return at
            at = at.parent
        return node
    return next((found[0] for s in rules.MOVE_TO.get(host, ()) if (found := select(node, s))), node)


def is_image_source(src: str | None) -> bool:
    """Whether an image is worth keeping."""
    s = (src or "").strip().lower()
    if not s:
        return False
    if s.startswith("data:"):
        return s.startswith(tuple(f"data:image/{x}" for x in rules.DATA_IMAGES))
    name = re.split("[?#]", s)[0].rsplit("/", 1)[-1]
    domain = re.split("[/?#]", s[2:] if s.startswith("//") else s.split("://", 1)[1] if "://" in s else "")[0]
    if name in rules.TRACKING_FILES or domain.startswith(rules.TRACKING_DOMAINS):
        return False

    def described(x: str) -> bool:
        stem, dot, ext = x.rsplit("/", 1)[-1].rpartition(".")
        return bool(dot) and ext in rules.IMAGE_EXTENSIONS and len(stem.strip()) >= 2

    if s.startswith(("http://", "https://", "//")):
        return not name or "." not in name or described(name)
    return s.startswith(("/", "./", "../")) or described(s)


class Contents:
    """Of every element below a node: length of its text, of its links' texts, and whether it has text or a good image; and
    the text itself in one line, so that a phrase is found in a subtree by its place. All bottom-up, in one go."""

    def __init__(self, root: Node):
        self.of: dict[Node, tuple[int, int, int, bool]] = {}  # characters, texts, link length, good image
        self.line: dict[Node, tuple[int, int]] = {}  # where the subtree's text lies in the line
        nodes = [root, *root.walk()]
        words, at = [], 0
        for n in nodes:
            if n.tag is None and (text := " ".join(n.text.lower().split())):
                self.line[n] = (at, at + len(text))
                words.append(text)
                at += len(text) + 1
        text = " ".join(words)
        self.phrases = [(len(p), [m.start() for m in re.finditer(f"(?={re.escape(p)})", text)]) for p in rules.BOILERPLATE_PHRASES]
        for n in reversed(nodes):
            if n.tag is None:
                t = n.text.strip()
                self.of[n] = (len(t), 1 if t else 0, 0, False)
                continue
            chars = texts = links = 0
            image = n.tag == "img" and is_image_source(n.attrs.get("src"))
            low = high = None
            for c in n.children:
                a = self.of[c]
                chars, texts, links, image = chars + a[0], texts + a[1], links + a[2], image or a[3]
                if c.tag == "a":
                    links += self.length(c)
                if c in self.line:
                    low, high = self.line[c][0] if low is None else low, self.line[c][1]
            self.of[n] = (chars, texts, links, image)
            if low is not None:
                self.line[n] = (low, high)

    def length(self, n: Node) -> int:
        chars, texts = self.of[n][:2]
        return chars + max(texts - 1, 0)

    def has_content(self, n: Node) -> bool:
        """Text, or an image worth keeping below."""
        return self.of[n][1] > 0 or any(self.of[c][3] for c in n.children)

    def has_phrase(self, n: Node) -> bool:
        low, high = self.line.get(n, (0, 0))
        return any((i := bisect_left(places, low)) < len(places) and places[i] + size <= high for size, places in self.phrases)

    def is_boilerplate(self, n: Node) -> bool:
        """The block test."""
        size = self.length(n)
        if not size:
            return False
        density = min(1.0, self.of[n][2] / size)
        c = n.class_id.strip()
        hint, strong = bool(_HINT.search(c)), bool(_STRONG.search(c))
        phrase = self.has_phrase(n)
        return (
            (strong and (size < 5000 or density > 0.08)) or (hint and size < 2500 and density > 0.05)
            or (is_unlikely(n.class_id) and (size < 1600 or density > 0.2)) or (phrase and hint and (density > 0.08 or size < 1200))
            or (phrase and density > 0.35) or (phrase and strong and size < 2500)
        )


def sanitize(node: Node, boilerplate: bool = True) -> None:
    """Remove empty links, bad images, boilerplate blocks and empty blocks below a node.

    Empty links and bad images change nothing that is measured; boilerplate is measured anew for each tag, and of nested
    blocks of one tag the outer one goes. So each step is linear in the page.
    """
    now = Contents(node)
    Node.remove_all(n for n in node.elements("a") if not now.has_content(n))
    Node.remove_all(n for n in node.elements("img") if not is_image_source(n.attrs.get("src")))
    if boilerplate:
        for tag in rules.BOILERPLATE_TAGS:
            if not (blocks := node.elements(tag)):
                continue
            now, gone = Contents(node), []
            upto = -1  # the place of the last node of a block that goes
            for n in blocks:
                if n.order > upto and now.is_boilerplate(n):
                    gone.append(n)
                    upto = max((x.order for x in n.walk()), default=n.order)
            Node.remove_all(gone)
    now = Contents(node)
    for tag in ("li", "p", "div"):
        Node.remove_all(n for n in node.elements(tag) if not now.has_content(n))


def absolutize(node: Node, base: str) -> None:
    """Resolve the URLs of the subtree."""
    for n in [node, *node.elements()]:
        for a in rules.URL_ATTRIBUTES.get(n.tag, ()):
            if n.attrs.get(a):
                try:
                    n.attrs[a] = absolute_srcset(base, n.attrs[a]) if a == "srcset" else urljoin(base, n.attrs[a])
                except ValueError:
                    pass


#: Rendered as safe HTML: these elements and attributes; of others only what they hold.
SAFE_TAGS = frozenset(
    "a abbr article aside b blockquote br caption code dd del details div dl dt em figcaption figure footer h1 h2 h3 h4 h5 h6 "
    "header hr i img ins kbd li main mark nav ol p picture pre q s samp section small source span strong sub summary sup table "
    "tbody td tfoot th thead time tr u ul var video audio track".split()
)
SAFE_ATTRIBUTES = frozenset("href src srcset alt title class id width height colspan rowspan datetime lang poster type".split())
DROPPED = frozenset(("script", "style", "noscript", "template", "iframe", "object", "embed"))
BLOCKS = frozenset(
    "address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)


#: Elements nested deeper than this are not rendered; what they hold is.
MOST_DEPTH = 250


def flattened(node: Node) -> None:
    """Put the children of elements that lie too deep in these elements' place."""
    todo = [(node, 0)]
    while todo:
        n, depth = todo.pop()
        if depth < MOST_DEPTH:
            todo.extend((c, depth + 1) for c in n.children)
        elif any(c.tag is not None and c.children for c in n.children):
            below = [c for c in n.walk() if c.tag is None or not c.children]
            n.children = []
            for c in below:
                n.append(c)


def is_safe_url(url: str) -> bool:
    return not url.strip().lower().startswith(("javascript:", "vbscript:", "data:text/html"))


def to_html(node: Node, safe: bool = True, indent: int = 2, level: int = 0) -> str:
    """Indented HTML; blocks that hold blocks are broken over lines."""
    if node.tag is None:
        return html_module.escape(node.text, quote=False)
    if safe and node.tag in DROPPED:
        return ""
    inner_level = level + (not safe or node.tag in SAFE_TAGS)
    blocks = any(c.tag in BLOCKS for c in node.children)
    parts = [to_html(c, safe, indent, inner_level) for c in node.children]
    if safe and node.tag not in SAFE_TAGS:
        return "\n".join(p for p in parts if p.strip()) if blocks else "".join(parts)
    attrs = "".join(
        f' {k}="{html_module.escape(v)}"' for k, v in node.attrs.items()
        if not safe or (k in SAFE_ATTRIBUTES and (k not in ("href", "src", "poster") or is_safe_url(v)))
    )
    pad = " " * (indent * level) if node.tag in BLOCKS else ""
    if node.tag in VOID:
        return f"{pad}<{node.tag}{attrs}>"
    if blocks and node.tag != "pre":
        body = "\n".join(p if p.startswith(" ") else " " * (indent * inner_level) + p.strip() for p in parts if p.strip())
        return f"{pad}<{node.tag}{attrs}>\n{body}\n{pad}</{node.tag}>"
    return f"{pad}<{node.tag}{attrs}>{''.join(parts)}</{node.tag}>"


def _inline(node: Node, safe: bool) -> str:
    out = []
    for c in node.children:
        if c.tag is None:
            out.append(re.sub(r"([\\`*_\[\]])", r"\\\1", re.sub(r"\s+", " ", c.text)))
        elif c.tag in DROPPED:
            continue
        elif c.tag == "br":
            out.append("  \n")
        elif c.tag == "img":
            src = c.attrs.get("src", "")
            if src and (not safe or is_safe_url(src)):
                out.append(f"![{c.attrs.get('alt', '')}]({src})")
        elif c.tag in ("code", "kbd", "samp"):
            text = "".join(t.text for t in c.walk() if t.tag is None)
            out.append(f"`{text}`" if text else "")
        else:
            text = _inline(c, safe)
            mark = "**" if c.tag in ("b", "strong") else "*" if c.tag in ("i", "em") else "~~" if c.tag in ("s", "strike", "del") else ""
            if c.tag == "a" and c.attrs.get("href") and text.strip() and (not safe or is_safe_url(c.attrs["href"])):
                out.append(f"[{text.strip()}]({c.attrs['href']})")
            elif mark and text.strip():
                lead, trail = text[: len(text) - len(text.lstrip())], text[len(text.rstrip()) :]
                out.append(f"{lead}{mark}{text.strip()}{mark}{trail}")
            else:
                out.append(text)
    return "".join(out)


def _blocks(node: Node, safe: bool) -> list[str]:
    out: list[str] = []
    run = Node("span")

    def flush() -> None:
        text = _inline(run, safe).strip()
        if text:
            out.append(text)
        run.children = []

    for c in node.children:
        if c.tag is None or c.tag not in BLOCKS:
            if c.tag is not None and any(x.tag in BLOCKS for x in c.walk()):
                flush()
                out.extend(_blocks(c, safe))
            else:
                run.children.append(c)
            continue
        flush()
        if c.tag[0] == "h" and c.tag[1:].isdigit():
            text = _inline(c, safe).strip()
            out += [f"{'#' * int(c.tag[1])} {text}"] if text else []
        elif c.tag == "hr":
            out.append("---")
        elif c.tag == "pre":
            text = "".join(t.text for t in c.walk() if t.tag is None).strip("\n")
            out.append(f"```\n{text}\n```")
        elif c.tag == "blockquote":
            inner = "\n\n".join(_blocks(c, safe))
            out += ["\n".join(f"> {line}".rstrip() for line in inner.split("\n"))] if inner else []
        elif c.tag in ("ul", "ol"):
            items = []
            for i, li in enumerate((x for x in c.children if x.tag == "li"), 1):
                lead = f"{i}. " if c.tag == "ol" else "- "
                inner = "\n".join(_blocks(li, safe))
                if inner:
                    items.append(lead + inner.replace("\n", "\n" + " " * len(lead)))
            out += ["\n".join(items)] if items else []
        elif c.tag == "table":
            rows = [[_inline(x, safe).strip().replace("|", "\\|").replace("\n", " ") for x in r.elements("td", "th")] for r in c.elements("tr")]
            rows = [r for r in rows if r]
            if rows:
                width = max(map(len, rows))
                lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
                out.append("\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]))
        else:
            out.extend(_blocks(c, safe))
    flush()
    return out


def to_markdown(node: Node, safe: bool = True) -> str:
    """Markdown of the subtree, blocks apart by an empty line."""
    return "\n\n".join(_blocks(node, safe))


def excerpt_of(text: str, length: int = rules.EXCERPT_CHARS) -> str:
    text = " ".join(text.split())
    if len(text) <= length:
        return text
    cut = text[:length]
    at = cut.rfind(" ")
    return (cut[:at] if at > 0.7 * length else cut).rstrip() + "..."


def _failed(url: str, error: str) -> dict:
    return {"url": url, "title": "", "content": "", "markdown": "", "excerpt": "", "word_count": 0, "success": False, "error": error, "author": None, "date_published": None, "language": None, "warnings": []}


def extract(html: str | bytes, url: str = "", options: Options = Options()) -> dict:
    """The article of one page; whatever a page holds, a failure is its own row and no one else's."""
    if isinstance(html, bytes):
        try:
            html = html.decode()
        except UnicodeDecodeError:
            html = html.decode("latin-1")
    try:
        root = parse(html)
    except Exception as e:  # whatever the tokenizer meets in a page
        return _failed(url, f"Failed to parse HTML: {e}")
    try:
        return _article(root, url, options)
    except Exception as e:
        return _failed(url, f"{type(e).__name__}: {e}")


def _article(root: Node, url: str, options: Options) -> dict:
    host = host_of(url)
    clean(root, host)
    out = _failed(url, "Could not find main content") | {"title": title_of(root, url)}
    node = top_candidate(root, Measures(root))
    if node is None:
        return out
    node = moved(node, host)
    if url:
        absolutize(node, url)
    sanitize(node, host not in rules.KEEP_BOILERPLATE)
    for s in rules.REMOVE.get(host, ()):
        Node.remove_all(select(node, s))
    text = node.string()
    flattened(node)
    content, markdown = to_html(node, options.safe_markdown), to_markdown(node, options.safe_markdown)
    if host == "infoworld.com":
        content, markdown, text = (_ARTIFACT.sub("", x) for x in (content, markdown, text))
    words = len(text.split())
    if words < options.min_words:
        out["warnings"] = [f"Content below minimum word count ({words} < {options.min_words})"]
    return out | {"content": content, "markdown": markdown, "excerpt": excerpt_of(text), "word_count": words, "success": True, "error": None}


def looks_extractable(html: str) -> bool:
    """Whether the answer to a missing page may still be an article."""
    low = html.lower()
    return len(html) >= rules.EXTRACTABLE_CHARS and any(t in low for t in rules.EXTRACTABLE_SIGNS)


def extract_response(html: str | None, status: int | None, url: str = "", options: Options = Options()) -> dict:
    """The article of an answer with its HTTP status; none is taken as good.

    404 and 410 may be pages made by scripts: what looks like an article is extracted with a warning. Other statuses from
    400 on fail, and so does an answer without a body.
    """
    if status is not None and status >= 400:
        if status in rules.GONE and html is not None and looks_extractable(html):
            got = extract(html, url, options)
            if got["success"]:
                return got | {"warnings": [*got["warnings"], f"Extracted after HTTP {status} (SPA/client-rendered)"]}
        return _failed(url, f"HTTP {status}")
    return extract(html, url, options) if html is not None else _failed(url, "No HTML")


_TYPES = [
    ("page_id", pa.int64()), ("url", pa.string()), ("title", pa.string()), ("content", pa.string()), ("markdown", pa.string()), ("excerpt", pa.string()),
    ("word_count", pa.int32()), ("success", pa.bool_()), ("error", pa.string()), ("author", pa.string()), ("date_published", pa.string()),
    ("language", pa.string()), ("warnings", pa.list_(pa.string())),
]


def extract_articles(pages: DataFrame, options: Options = Options(), status_col: str | None = None) -> DataFrame:
    """(page_id, url, html), and a status where ``status_col`` names it -> one article row per page; pages of null html fail."""
    schema = pa.schema(_TYPES)
    status = F.lit(None) if status_col is None else F.col(status_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                rows = []
                for page, url, html, code in zip(*(c.to_pylist() for c in batch.slice(low, 64).columns), strict=True):
                    got = extract_response(html, code, url or "", options)
                    rows.append([page, *(got[k] for k, _ in _TYPES[1:])])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _TYPES, strict=True)], schema=schema)

    return spread(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", status.cast("int").alias("status"))).mapInArrow(run, ARTICLE_SCHEMA)
