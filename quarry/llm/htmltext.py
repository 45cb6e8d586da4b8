"""Main text of web pages by equivalence-class template deduction.

A page is read as tokens: its containers by path (names with class or id, and their number among siblings) and its
text blocks by path and text. Over the distinct pages of a host each token has an occurrence vector, how often each
page has it; tokens with the same vector form an equivalence class. The class of the tokens that every page has
exactly once, led by the page's root, is the template. A further class is nested into it if at least half of the
host's pages have it, it has three tokens, and all of them lie below one container of the template; its containers
may then hold further classes, level by level.

Text of the template is no content. What is left lies in the template's slots: from the root down the container
with at least half of the slots' text is entered, over all pages of the host and then on the page itself, until one
has headings or paragraphs of its own and no marked part; text of links counts nothing there, text outside of headings, paragraphs and
the like a quarter. Marks (article, main) only weigh text more, and blocks below elements that the page itself marks
as no content (menus, headers, footers, sidebars, notices, adverts, forms, comments) weigh nothing and are removed.
A main part, or article, with nothing but template is a repeated article and stays whole.

Vectors are compared by a hash summed over pages, each row of a page that the host has several times counting its
part, so no host's pages are ever gathered in one place. What is gathered of a host are the tokens that half of its
pages have, at most twice as many as an average page has.

Defined results: null and empty html gives an empty text; a host with fewer than 3 distinct pages has no template,
its pages are read alone; a null or odd url belongs to the host of empty name; repeated rows each get their row and
count once for the template; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import small_side, spread_join, stored

LEXER = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|[^<]+|<", re.S
)
ATTR = re.compile(r"""([A-Za-z_:][\w:.-]*)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
#: Elements whose content is no text of the page, that end nothing, that flow inside a block, and that hold no content.
RAW = frozenset({"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "noembed", "noframes", "xmp"})
MARKUP = frozenset({"noscript", "template", "svg", "math"})  # those of RAW that hold elements themselves
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in RAW}
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
INLINE = frozenset({"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"})
OUTSIDE = frozenset({"head", "nav", "header", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "fieldset", "object", "audio", "video", "canvas"})
ROLES = frozenset({"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form", "toolbar", "status"})
WORDS = frozenset({"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "sidebar", "aside", "nav", "navbar", "navigation", "menu", "menubar", "header", "masthead", "footer", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "promo", "promotion", "promoted", "sponsor", "sponsored", "sponsors", "share", "sharing", "social", "related", "recommended", "comment", "comments", "commentlist", "respond", "replies", "disqus", "breadcrumb", "breadcrumbs", "toolbar", "widget", "widgets", "pagination", "pager", "toc", "copyright", "disclaimer", "skip", "search", "form"})
PROSE = frozenset({"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "li", "dd", "dt", "td", "th", "figcaption", "caption", "summary"})
HEADED = frozenset({"p", "h1", "h2", "h3", "h4", "h5", "h6"})  # a container with one of these is content itself
CLOSES_P = frozenset({"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"})
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = frozenset({"ul", "ol", "dl", "menu", "table", "select"})


DEPTH = 64  # elements nested deeper share the path of this depth
FLUSH = 50_000  # tokens that a task holds before it hands them on


class Node:
    """A block element: its path, whether it is marked as no content, as article (2) or main part (1)."""

    __slots__ = ("inner", "main", "name", "out", "parent", "path", "seen")

    def __init__(self, parent: Node | None, name: str, label: str, out: bool, main: int, deep: bool):
        self.parent, self.name, self.out, self.main, self.inner, self.seen = parent, name, out, main, main > 0 or not parent, None
        if not parent:
            self.path = ""
        elif deep:
            self.path = parent.path
        else:
            if parent.seen is None:
                parent.seen = {}
            k = parent.seen[label] = parent.seen.get(label, 0) + 1
            self.path = f"{parent.path}/{label}[{k}]"


class Block:
    """A stretch of text between block boundaries: the element that it stands in, and whether that is marked."""

    __slots__ = ("body", "links", "main", "node", "out", "parts")

    def __init__(self, node: Node, out: bool, main: int):
        self.node, self.out, self.main, self.parts, self.links, self.body = node, out, main, [], 0, None

    def text(self) -> str:
        if self.body is None:
            self.body = " ".join(entities.unescape("".join(self.parts)).split())
        return self.body

    @property
    def home(self) -> Node:
        """The container that the block lies in."""
        return self.node if self.node.inner else self.node.parent

    @property
    def path(self) -> str:
        return self.home.path if self.node.inner else f"{self.home.path}/{self.node.name}"

    def weight(self) -> int:
        """Quarters of characters that speak for its container being the main one."""
        free = len(self.text()) - self.links
        return 0 if free <= 0 else free * (4 if self.node.name in PROSE else 1) * (1, 2, 8)[self.main]

    def headed(self) -> bool:
        return self.node.name in HEADED and len(self.text()) > self.links


def _marks(name: str, attrs: dict[str, str]) -> tuple[str, bool, int]:
    """The element's name in a path; whether it holds no content; 2 for the article, 1 for a main part."""
    if not attrs:
        return name, name in OUTSIDE, 2 if name == "article" else 1 if name == "main" else 0
    label = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()
    words = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{attrs.get('class', '')} {attrs.get('id', '')}").lower()))
    role = attrs.get("role", "").lower()
    out = name in OUTSIDE or role in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or (bool(words & WORDS) and name not in ("html", "body", "article", "main"))
    if name in ("article", "main"):  # an article can be a comment or an advert as well
        out = out or bool(words & {"comment", "comments", "reply", "ad", "ads", "advert", "sponsored", "promo", "related", "teaser"})
    main = 2 if name == "article" or attrs.get("itemprop", "").lower() == "articlebody" or role == "article" else 1 if name == "main" or role == "main" else 0
    label = label.strip().replace("/", "|")
    return f"{name}.{label}" if label else name, out, main


def parse(page: str) -> list[Block]:
    """Text blocks in page order."""
    root = Node(None, "", "", False, 0, False)
    stack: list[tuple[str, Node, bool, int]] = [("", root, False, 0)]
    blocks = [Block(root, False, 0)]
    raw, at, linked = None, 0, 0

    def boundary():
        if blocks[-1].parts:
            blocks.append(None)
        blocks[-1] = Block(*stack[-1][1:])

    def after(name: str) -> int:
        """Where the content of a raw element that starts here ends."""
        end = RAW_END[name].search(page, at)
        return end.end() if end else len(page)

    while m := LEXER.match(page, at):
        at = m.end()
        closing, name = m[1], m[2]
        if raw:
            low = name.lower() if name else ""
            if closing and low == raw:
                raw = None
            elif not closing and low in RAW - MARKUP and not m[3].endswith("/"):
                at = after(low)
            continue
        if not name:
            if m[0][0] != "<" or m[0] == "<":
                blocks[-1].parts.append(m[0])
                if linked and any(x[0] == "a" for x in stack):
                    blocks[-1].links += len(m[0])
            elif m[0].startswith("<![CDATA["):
                blocks[-1].parts.append(entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        name = name.lower()
        if name == "br" or name == "wbr" and not closing:
            blocks[-1].parts.append(" " if name == "br" else "")
            continue
        if closing:
            if name in INLINE:
                for d in range(len(stack) - 1, 0, -1):
                    if stack[d][0] == name:
                        if all(x[0] in INLINE for x in stack[d:]):
                            changed = stack[d][2] != stack[d - 1][2]
                            del stack[d:]
                            if changed:
                                boundary()
                        break
                    if stack[d][0] not in INLINE:
                        break
                continue
            for d in range(len(stack) - 1, 0, -1):
                if stack[d][0] == name:
                    del stack[d:]
                    break
            boundary()
            continue
        attrs = {k.lower(): v.strip("\"'") for k, v in ATTR.findall(m[3])} | ({"hidden": ""} if re.search(r"\shidden(\s|/|$)", m[3]) else {}) if m[3] else {}
        if name in RAW:
            if name in MARKUP:
                raw = None if m[3].endswith("/") else name
            elif not m[3].endswith("/"):
                at = after(name)
            continue
        if name in VOID:
            if name == "hr":
                boundary()
            continue
        label, out, main = _marks(name, attrs)
        if name in INLINE:
            parent = stack[-1]
            stack.append((name, parent[1], parent[2] or out, parent[3]))
            linked += name == "a"
            if out and not parent[2]:
                boundary()
            continue
        if name in CLOSES_P:
            _close(stack, {"p"}, CLOSES_P - {"p"} | {"li", "td", "th", "dd", "dt"})
        if name in SIBLINGS:
            _close(stack, SIBLINGS[name], LISTS)
        while stack[-1][0] in INLINE:  # formatting left open doesn't reach over blocks
            stack.pop()
        _, parent, above, level = stack[-1]
        parent.inner = True
        node = Node(parent, name, label, above or out, main, len(stack) > DEPTH)
        stack.append((name, node, above or out, max(level, main)))
        boundary()
    return [b for b in blocks if b.parts and b.text()]


class Tree:
    """Containers by path: the weight of the text below each, of headings and paragraphs right in it, and its mark."""

    def __init__(self):
        self.weight, self.headed, self.main = {"": 0.0}, {"": 0.0}, {"": 0}

    def add(self, path: str, weight: float, headed: float, main: int = 0) -> None:
        self.weight[path] = self.weight.get(path, 0.0) + weight
        self.headed[path] = self.headed.get(path, 0.0) + headed
        self.main[path] = max(self.main.get(path, 0), main)

    def above(self, path: str, weight: float) -> None:
        """Weight of a text at path for every container around it."""
        while True:
            if path in self.weight:
                self.weight[path] += weight
            if not path:
                return
            path = path.rpartition("/")[0]

    def descend(self, at: str = "") -> str:
        """The main container below `at`."""
        children: dict[str, list[str]] = {}
        for path in self.weight:
            up = path
            while up:
                up = up.rpartition("/")[0]
                if up in self.weight:
                    children.setdefault(up, []).append(path)
                    break
        marked = set()
        for path in [p for p, m in self.main.items() if m]:
            while path and path not in marked:
                marked.add(path)
                path = path.rpartition("/")[0]
        while self.main[at] < 2:
            best = max(children.get(at, ()), key=lambda p: (self.weight[p], p), default=None)
            if best is None or self.weight[best] <= 0 or 2 * self.weight[best] < self.weight[at] or (self.headed[at] >= 0.5 and best not in marked):
                break
            at = best
        return at


def tree_of(blocks: list[Block]) -> Tree:
    """The containers of one page with the weights of these of its blocks."""
    tree, own = Tree(), {}
    for b in blocks:
        n = b.home
        own[n] = [x + y for x, y in zip(own.get(n, (0, 0)), (b.weight(), b.headed()), strict=True)]
    for n, (weight, headed) in own.items():
        tree.add(n.path, 0, headed)
        while n:
            tree.add(n.path, weight, 0, n.main)
            n = n.parent
    return tree


def _close(stack: list, names: set[str], stop: frozenset[str] | set[str]) -> None:
    """Ends the innermost open element of these names, unless one of `stop` is open inside."""
    for d in range(len(stack) - 1, 0, -1):
        if stack[d][0] in names:
            del stack[d:]
            return
        if stack[d][0] in stop:
            return


def _token(kind: str, *parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join((kind, *parts)).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def host(url: str = "url") -> Column:
    return F.lower(F.coalesce(F.regexp_extract(F.col(url).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


P = 2147483647  # a prime; each row of a page that occurs r times counts 1/r modulo it


def _occurrences(batches):
    """(host, page, rows, part, token, kind, path, n, weight, headed, main) of each page, part being 1/rows modulo P."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def batch(cols):
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["host", "page", "rows", "part", "token", "kind", "path", "n", "weight", "headed", "main"])

    for b in batches:
        cols: list[list] = [[] for _ in kinds]
        for where, page, again, text in zip(*(b.column(c).to_pylist() for c in ("host", "page", "rows", "html")), strict=True):
            if not text:
                continue
            blocks = [x for x in parse(text) if not x.out]
            tree = tree_of(blocks)
            rows = [(_token("path", p), "path", p, 1, int(w), int(tree.headed[p]), tree.main[p]) for p, w in tree.weight.items()]
            seen: dict[tuple[str, str], list[int]] = {}
            for x in blocks:
                s = seen.setdefault((x.path, x.text()), [0, 0, 0])
                s[0], s[1], s[2] = s[0] + 1, s[1] + x.weight(), s[2] + x.headed()
            rows += [(_token("text", p, t), "text", p, n, w, h, 0) for (p, t), (n, w, h) in seen.items()]
            for row in rows:
                for c, v in zip(cols, (where, page, again, pow(again, -1, P), *row), strict=True):
                    c.append(v)
            if len(cols[0]) >= FLUSH:
                yield batch(cols)
                cols = [[] for _ in kinds]
        yield batch(cols)


def deduced(tokens: list[dict], size: int = 3) -> tuple[list[int], str]:
    """The template's text tokens and the main container of a host, from the tokens that half of its pages have.

    tokens: token, kind, path, vector, weight and headed over all pages (as a page has them on average), main.
    """
    classes: dict[tuple, list[dict]] = {}
    for t in tokens:
        classes.setdefault(t["vector"], []).append(t)
    root = next(v for v, ts in classes.items() if any(t["kind"] == "path" and t["path"] == "" for t in ts))
    frame = {t["path"] for t in classes[root] if t["kind"] == "path"}
    inside = {root}

    def below(path: str) -> str:
        while path not in frame:
            path = path.rpartition("/")[0]
        return path

    while True:  # level by level
        found = [
            v for v, ts in classes.items() if v not in inside and len(ts) >= size
            and all(p == q or p.startswith(f"{q}/") for q in [below(min((t["path"] for t in ts), key=len))] for p in (t["path"] for t in ts))
        ]
        if not found:
            break
        inside.update(found)
        frame |= {t["path"] for v in found for t in classes[v] if t["kind"] == "path"}
    tree = Tree()
    for t in classes[root]:
        if t["kind"] == "path":
            tree.add(t["path"], t["weight"], t["headed"], t["main"])
    texts, raw = [], dict(tree.weight)
    for v in inside:
        for t in classes[v]:
            if t["kind"] == "text":
                texts.append(t["token"])
                tree.above(t["path"], -t["weight"])
                home = t["path"] if t["path"] in tree.headed else t["path"].rpartition("/")[0]
                if home in tree.headed:
                    tree.headed[home] -= t["headed"]
    if tree.weight[""] < 0.5:  # pages with nothing of their own: copies of an article
        tree.weight = raw
    return sorted(texts), tree.descend()


def _deduce(batches):
    for b in batches:
        got = []
        for total, tokens in zip(b.column("total").to_pylist(), b.column("tokens").to_pylist(), strict=True):
            for t in tokens:
                t["vector"] = (t["v1"], t["v2"])
                t["weight"], t["headed"] = t["weight"] / total, t["headed"] / total
            got.append(deduced(tokens))
        yield pa.record_batch([b.column("host"), pa.array([x for x, _ in got], pa.list_(pa.int64())), pa.array([x for _, x in got], pa.string())], ["host", "texts", "main"])


def templates(pages: DataFrame, least: int = 3, share: float = 0.5) -> DataFrame:
    """host, texts (the text tokens of the template), main (the path of the main container), of hosts with `least` distinct pages.

    pages: host, page (hash of the html), rows (how often the host has it), html.
    """
    rows = pages.select("host", "page", "rows", "html").mapInArrow(_occurrences, "host string, page long, rows long, part long, token long, kind string, path string, n long, weight long, headed long, main long")
    half = lambda *c: (F.pmod(F.xxhash64(*c), F.lit(P)) * F.col("part")) % P
    one = 1.0 / F.col("rows")
    tokens = rows.groupBy("host", "token", "kind", "path").agg(
        (F.sum(half("page", "n")) % P).alias("v1"), (F.sum(half("n", "page")) % P).alias("v2"), F.round(F.sum(one)).cast("long").alias("pages"),
        F.sum(F.col("weight") * one).alias("weight"), F.sum(F.col("headed") * one).alias("headed"), F.max("main").alias("main"),
    ).where(F.col("pages") >= least)
    tokens = stored(tokens, "tokens")
    total = tokens.where("kind = 'path' and path = ''").select("host", F.col("pages").alias("total"))
    many = tokens.join(small_side(total, total.count()), "host").where(F.col("pages") >= F.ceil(F.col("total") * share))
    per_host = many.groupBy("host", "total").agg(F.collect_list(F.struct("token", "kind", "path", "v1", "v2", "weight", "headed", "main")).alias("tokens"))  # at most 1/share times the tokens of a page
    return per_host.mapInArrow(_deduce, "host string, texts array<long>, main string")


def extracted(page: str, texts: set[int], main: str | None) -> str:
    """The text of one page, given its host's template (main is None if there is none)."""
    blocks = [x for x in parse(page) if not x.out]
    fresh = [x for x in blocks if _token("text", x.path, x.text()) not in texts] if texts else blocks
    tree = tree_of(fresh)
    if tree.weight[""] <= 0:
        tree = tree_of(blocks)
    if tree.weight[""] <= 0 and any(x.main for x in blocks):  # links alone: the mark is all there is to go by
        level = max(x.main for x in blocks)
        return "\n\n".join(x.text() for x in blocks if x.main == level)
    at = main or ""
    while at not in tree.weight:
        at = at.rpartition("/")[0]
    at = tree.descend(at)
    under = lambda x: x.home.path == at or x.home.path.startswith(f"{at}/")
    own = [x for x in fresh if under(x)]
    if not any(x.main == 2 for x in own):  # a repeated article stays
        kept = set(own)
        own = [x for x in blocks if x in kept or (x.main == 2 and under(x))]
    own = own or [x for x in blocks if under(x)]
    return "\n\n".join(x.text() for x in own)


def _extract(batches):
    for b in batches:
        out, of = [], {}
        for host, page, texts, main in zip(*(b.column(c).to_pylist() for c in ("host", "html", "texts", "main")), strict=True):
            if host not in of:
                of = {host: set(texts or ())}
            out.append(extracted(page, of[host], main) if page else "")
        n = pa.array([len(t) for t in out], pa.int64())
        yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), n], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, broadcast_mb: float = 32.0, per_task: int = 100_000) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Templates of up to broadcast_mb together are sent to every task; more are joined by host, of a host at most
    per_task pages in a task.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", host().alias("host"))
    rows = rows.withColumn("page", F.xxhash64("html"))
    again = stored(rows.groupBy("host", "page").agg(F.count("*").alias("rows")).where("rows > 1"), "again")
    counted = rows.join(small_side(again, again.count()), ["host", "page"], "left").withColumn("rows", F.coalesce("rows", F.lit(1).cast("long")))
    found = stored(templates(counted), "templates")
    known = found.agg(F.count("*"), F.coalesce(F.sum(F.size("texts")), F.lit(0))).first()
    size = 128 * known[0] + 8 * known[1]
    joined = rows.join(F.broadcast(found), "host", "left") if size <= broadcast_mb * 1e6 else spread_join(rows, found, "host", "page", per_task)
    return joined.select("page_id", "url", "html", "host", "texts", "main").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
