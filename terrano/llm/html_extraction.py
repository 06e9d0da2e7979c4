"""HTML main-text extraction: gradient-boosted trees over DOM nodes, decoded hierarchically.

A page becomes a tree of block elements.  Text that stands beside other blocks in its block is a leaf
of its own, so a line of notice between the blocks of a kept element is judged by itself.  Every node
gets features: its tag and its ancestors', attribute tokens, depth, text and link density of its
subtree, place in the page, and how it compares with its siblings.  Boosted trees give each node
log-odds of holding main text; the decoding picks the subset of nodes, closed under ancestors, of
the largest total (a dynamic program over the tree), so a node is never kept inside one that is
dropped.

The parser reads a page once from front to back, whatever its markup: a tag without an end is
found out once, open elements are looked up by name.

The trees are fitted on pages that a seeded generator writes from page grammars with known main
text (bounded: TRAIN_PAGES), never on the pages to be extracted.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare
from .trees import Boosted

TRAIN_PAGES = 800
SEED = 7
#: Characters of pages whose nodes are scored together.
BATCH = 1 << 19
#: Kinds of elements.
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SILENT = set("script style noscript template textarea select option button svg iframe title head object canvas audio video datalist math".split())
RAW = set("script style noscript template textarea title iframe svg".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening tag closes if it stands open.
CLOSES = {t: {"p"} for t in BLOCK} | {"li": {"p", "li"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"}, "tr": {"p", "tr", "td", "th"}, "td": {"p", "td", "th"}, "th": {"p", "td", "th"}, "body": {"head"}}
#: Elements that an implied end does not pass.
WALL = {"ul", "ol", "table", "div", "section", "article", "body", "td", "th", "blockquote", "dl", "form", "main", "aside", "nav", "footer", "header", "menu"}
CELLS = {"td", "th", "table"}
#: End tags that close their element through an open cell.
TABLES = {"table", "tr", "tbody", "thead", "tfoot", "td", "th"}
NEGATIVE = "nav menu header footer sidebar aside ad ads advert banner cookie consent notice comment comments reply related share social promo sponsor widget breadcrumb pager toolbar subscribe newsletter login search form copyright legal popup modal masthead".split()
POSITIVE = "article content main post entry body text story prose page blog".split()
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: Attributes: quoted values, and single characters up to the next quote or end.
PLAIN = re.compile(r"[^>\"']*")
ATTR = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPLIT = re.compile(r"[^a-z]+")
WHITE = re.compile(r"\s+")
STOP = re.compile(r"[.!?,;:]")
KINDS = ["#text", "div", "p", "li", "ul", "nav", "header", "footer", "aside", "article", "main", "section", "form", "h", "table", "blockquote", "body"]


class Node:
    __slots__ = ("tag", "tokens", "parent", "children", "depth", "links", "own", "tags", "truth", "order")

    def __init__(self, tag, tokens, parent):
        self.tag, self.tokens, self.parent = tag, tokens, parent
        self.children = []
        self.depth = parent.depth + 1 if parent else 0
        self.links = self.own = self.tags = 0
        self.truth = False


class Scanner:
    """Ends of tags, comments and raw elements, each part of the page read once."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in "\"'>"}
        self.strict = True

    def tag_end(self, at: int) -> int:
        """The place of the > that ends a tag whose attributes begin at `at`, -1 without one.

        A > within quotes does not count.  If quotes swallow the rest of the page, they mean nothing from there on.
        """
        page, i = self.page, at
        if self.last[">"] < at:
            return -1
        while self.strict:
            i = PLAIN.match(page, i).end()
            if i >= len(page):
                self.strict = False
                break
            c = page[i]
            if c == ">":
                return i
            j = i - 1
            while j >= at and page[j].isspace():
                j -= 1
            if page[j] == "=" and j >= at and self.last[c] > i:
                i = page.index(c, i + 1)
            i += 1
        return page.find(">", at)


def parse(page: str) -> tuple[Node, list[tuple[Node, str]]]:
    """(root, [(node, text)] in page order); inline elements belong to the block around them.

    The text of a block without others in it belongs to the block; beside other blocks it is a leaf.
    """
    root = Node("body", (), None)
    stack: list[tuple[str, Node]] = [("body", root)]  # every open element with its block
    places: dict[str, list[int]] = {}  # by tag, where on the stack it stands open
    walls: list[int] = [0]
    cells: list[int] = []
    texts: list[tuple[Node, str]] = []
    buffer: list[str] = []
    links = silent = linked = at = 0
    scan = Scanner(page)

    def flush(node):
        nonlocal linked
        if buffer:
            t = WHITE.sub(" ", html.unescape("".join(buffer))).strip()
            if t:
                leaf = Node("#text", (), node)
                leaf.own, leaf.links = len(t), linked
                node.children.append(leaf)
                texts.append((leaf, t))
            buffer.clear()
        linked = 0

    def close(i):
        """Closes the elements of the stack from place i on."""
        nonlocal links, silent
        if stack[-1][1] is not stack[i - 1][1]:
            flush(stack[-1][1])
        for j in range(len(stack) - 1, i - 1, -1):
            tag = stack[j][0]
            links -= tag == "a"
            silent -= tag in SILENT
            places[tag].pop()
            if tag in WALL:
                walls.pop()
            if tag in CELLS:
                cells.pop()
        del stack[i:]

    end = len(page)
    while at < end:
        start = page.find("<", at)
        start = end if start < 0 else start
        if start > at and not silent:
            data = page[at:start]
            buffer.append(data)
            if links:
                linked += len(data.strip())
        if start >= end:
            break
        m = NAME.match(page, start + 1)
        if not m:
            if page.startswith("<!--", start):
                z = page.find("-->", start + 4)
                at = z + 3 if z >= 0 else end
            elif page[start + 1 : start + 2] in ("!", "?", "/"):
                z = page.find(">", start)
                at = z + 1 if z >= 0 else end
            else:  # a < that begins no tag
                if not silent:
                    buffer.append("<")
                at = start + 1
            continue
        z = scan.tag_end(m.end())
        if z < 0:
            break
        tag, ending, attrs = m[2].lower(), bool(m[1]), page[m.end() : z]
        at = z + 1
        if ending:
            open_ = places.get(tag)
            if open_ and (tag in TABLES or not cells or cells[-1] <= open_[-1]):
                close(open_[-1])
            continue
        if tag in RAW and not attrs.endswith("/"):
            z = raw_end(tag).search(page, at)
            at = z.end() if z else end
            continue
        node = stack[-1][1]
        node.tags += 1
        if tag in ("br", "wbr", "hr"):
            buffer.append(" ")
        if tag in ("html", "body"):
            continue
        for shut in CLOSES.get(tag, ()):
            open_ = places.get(shut)
            if open_ and open_[-1] >= walls[-1]:
                close(open_[-1])
        node = stack[-1][1]
        if tag in BLOCK and tag != "hr":
            flush(node)
            if not silent:
                words = {w for a in ATTR.findall(attrs) for w in SPLIT.split("".join(a).lower()) if w} if attrs else ()
                new = Node(tag, words, node)
                node.children.append(new)
                node = new
        if tag in VOID or attrs.endswith("/"):
            continue
        places.setdefault(tag, []).append(len(stack))
        if tag in WALL:
            walls.append(len(stack))
        if tag in CELLS:
            cells.append(len(stack))
        stack.append((tag, node))
        links += tag == "a"
        silent += tag in SILENT
    flush(stack[-1][1])
    for i, (leaf, t) in enumerate(texts):
        node = leaf.parent
        if len(node.children) == 1 and node.parent:  # the text of this block alone
            node.own, node.links = leaf.own, leaf.links
            node.children = []
            texts[i] = node, t
    return root, texts


NEG, POS = set(NEGATIVE), set(POSITIVE)


@lru_cache(maxsize=64)
def raw_end(tag: str) -> re.Pattern:
    return re.compile(f"</{re.escape(tag)}\\s*>", re.I)


#: Features besides the kinds of elements.
OTHER = 33


def features(root: Node, texts: list[tuple[Node, str]]) -> tuple[list[Node], np.ndarray, np.ndarray]:
    """(blocks, parents before children; feature rows; each block's parent index)."""
    nodes, todo = [], [root]
    while todo:
        n = todo.pop()
        n.order = len(nodes)
        nodes.append(n)
        todo.extend(reversed(n.children))
    size = len(nodes)
    own, stops, words, place = np.zeros(size), np.zeros(size), np.zeros(size), np.full(size, -1.0)
    done = 0
    for n, t in texts:
        i = n.order
        own[i] += len(t)
        stops[i] += len(STOP.findall(t))
        words[i] += t.count(" ") + 1
        if place[i] < 0:
            place[i] = done
        done += len(t)
    parent = np.array([n.parent.order if n.parent else -1 for n in nodes])
    links = np.array([min(n.links, n.own) for n in nodes], dtype=float)
    tags = np.array([n.tags + 1 for n in nodes], dtype=float)
    deep = np.stack([own, stops, words, links, tags, np.array([n.tag == "p" for n in nodes], float)], axis=1)
    for i in range(size - 1, 0, -1):
        deep[parent[i]] += deep[i]
        if place[i] >= 0 and not 0 <= place[parent[i]] <= place[i]:
            place[parent[i]] = place[i]
    total = max(done, 1)
    rows = np.zeros((size, OTHER + len(KINDS)))
    for i, n in enumerate(nodes):
        p = parent[i]
        neg, pos = len(NEG.intersection(n.tokens)) if n.tokens else 0, len(POS.intersection(n.tokens)) if n.tokens else 0
        bad = neg > 0 or n.tag in ("nav", "aside", "footer", "form", "menu")
        good = pos > 0 or n.tag in ("article", "main")
        r = rows[i]
        r[0], r[1] = neg, pos
        r[2] = (rows[p, 2] if p >= 0 else 0) + bad
        r[3] = (rows[p, 3] if p >= 0 else 0) + good
        r[4] = n.depth
        sib = nodes[p].children if p >= 0 else [n]
        r[5] = len(sib)
        r[17] = rows[p, 0] if p >= 0 else 0
        r[18] = rows[p, 1] if p >= 0 else 0
        r[19] = n.tag == "header" or (p >= 0 and rows[p, 19] > 0)
        kind = "h" if len(n.tag) == 2 and n.tag[0] == "h" and n.tag[1] in "123456" else n.tag
        if kind in KINDS:
            r[OTHER + KINDS.index(kind)] = 1
    for n in nodes:  # siblings
        kids = [c.order for c in n.children]
        if kids:
            k = deep[kids, 0]
            rows[kids, 6] = np.arange(len(kids)) / len(kids)
            rows[kids, 7] = np.log1p(np.concatenate(([0], k[:-1])))
            rows[kids, 8] = np.log1p(np.concatenate((k[1:], [0])))
            rows[kids, 9] = k / max(k.max(), 1)
            same = [c.tag for c in n.children]
            of = Counter(same)
            rows[kids, 10] = [of[t] / len(same) for t in same]
            # whether another child is marked as main text, and how much of the parent's text the largest other child has
            marks = np.array([c.tag in ("article", "main") or bool(c.tokens and POS.intersection(c.tokens)) for c in n.children])
            rows[kids, 30] = marks.sum() - marks > 0
            top = np.sort(k)[-2:]
            rows[kids, 31] = np.where(k < top[-1], top[-1], top[0] if len(top) > 1 else 0) / max(k.sum(), 1)
            paras_of = np.array([c.tag == "p" for c in n.children])
            rows[kids, 32] = (paras_of.sum() - paras_of) / len(kids)
    text, punct, word, link, tag, paras = deep.T
    rows[:, 11] = np.log1p(text)
    rows[:, 12] = link / np.maximum(text, 1)
    rows[:, 13] = punct / np.maximum(word, 1)
    rows[:, 14] = np.log1p(text / tag)
    rows[:, 15] = text / total
    rows[:, 16] = np.where(place >= 0, place / total, -1)
    rows[:, 20] = np.log1p(own)
    rows[:, 21] = np.log1p(word)
    rows[:, 22] = np.log1p(paras)
    up = np.maximum(parent, 0)
    for j, c in enumerate((11, 12, 13, 15, 9)):
        rows[:, 23 + j] = rows[up, c]
    rows[:, 28] = np.log1p([len(n.children) for n in nodes])
    rows[:, 29] = rows[up, 5]
    return nodes, rows, parent


def decode(margin: np.ndarray, parent: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The kept blocks: the subset closed under parents of the largest weighted log-odds."""
    best = margin * weight
    for i in range(len(best) - 1, 0, -1):
        if best[i] > 0:
            best[parent[i]] += best[i]
    keep = best > 0
    for i in range(1, len(best)):
        keep[i] &= keep[parent[i]]
    return keep


# --- pages to learn from -------------------------------------------------------------------------

SYLLABLES = "ka lo mi ren tas vo du el shi par non ber ost ume qua ly ing ter ra so".split()


def _words(r: random.Random, n: int) -> str:
    out = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n)]
    for i in range(0, n, r.randint(5, 14)):
        out[i] = out[i].capitalize()
    return " ".join(x + r.choice(["", "", "", "", "", ",", "."]) for x in out)


def page(r: random.Random) -> str:
    """A page; every run of main text starts with the mark \\x01."""
    def tag(name, inner, attrs=""):
        return f"<{name}{' ' + attrs if attrs else ''}>{inner}</{name}>"

    def cls(*names):
        n = r.choice(names)
        return r.choice([f'class="{n}"', f'id="{n}"', f'class="{n} {r.choice(["wrap", "box", "row", "col", "clear"])}"'])

    def link(n=None):
        return tag("a", _words(r, n or r.randint(1, 3)), f'href="/{r.choice(SYLLABLES)}"')

    def menu():
        items = [link() for _ in range(r.randint(3, 9))]
        inner = tag("ul", "".join(tag("li", x) for x in items)) if r.random() < 0.7 else " ".join(items)
        return tag("nav", inner, r.choice(["", cls("menu", "topnav")])) if r.random() < 0.6 else tag("div", inner, cls("nav", "menu", "main-menu", "breadcrumb"))

    def noise():
        kind = r.randrange(8)
        t = _words(r, r.randint(3, 25))
        if kind == 0:
            return tag("div", t, cls("ad", "advert", "ad-box", "banner", "sponsor"))
        if kind == 1:
            return tag(r.choice(["aside", "div"]), tag("h3", _words(r, 2)) + tag("ul", "".join(tag("li", link(r.randint(2, 8))) for _ in range(r.randint(2, 7)))), cls("sidebar", "related", "widget"))
        if kind == 2:
            return tag("div", tag("p", t) + tag("button", "OK"), cls("cookie-notice", "consent", "cookie", "notice", "popup"))
        if kind == 3:
            return tag("form", t + '<input name="q">' + tag("button", "go"), r.choice(["", cls("search", "newsletter", "subscribe")]))
        if kind == 4:
            return tag("aside", tag("p", t) if r.random() < 0.5 else t)
        if kind == 5:
            return tag("div", " ".join(link(1) for _ in range(r.randint(2, 6))), cls("share", "social", "toolbar"))
        if kind == 6:
            return menu()
        return tag("div", t, cls("promo", "banner", "ads"))

    def loose():
        """Text without a block of its own that is no main text."""
        return " " + _words(r, r.randint(2, 18)) + (" " + link() if r.random() < 0.3 else "") + " "

    def comments():
        one = lambda: tag("div", tag("b", _words(r, 1)) + tag("p", _words(r, r.randint(4, 60))), cls("comment", "reply"))
        return tag(r.choice(["section", "div"]), tag("h3", _words(r, 1)) + "".join(one() for _ in range(r.randint(1, 6))), cls("comments", "comment-list"))

    def block():
        n = int(r.choice([1, 4, 20, 60, 150]) * r.uniform(0.5, 1.5)) + 1
        t = _words(r, n)
        if r.random() < 0.25:
            t = t.replace(" ", r.choice([" <b>x</b> ", " <br>", " &amp; ", "### ", " " + link(2) + " "]), r.randint(1, 3))
        if r.random() < 0.1:
            t = "<b>" + t
        x = r.random()
        if x < 0.75:
            return "<p>" + t + ("</p>" if r.random() < 0.85 else "")
        if x < 0.82:
            return tag(r.choice(["h2", "h3"]), _words(r, r.randint(1, 8)))
        if x < 0.88:
            return tag(r.choice(["ul", "ol"]), "".join(tag("li", _words(r, r.randint(2, 25))) for _ in range(r.randint(1, 6))))
        if x < 0.93:
            return tag("blockquote", tag("p", t) if r.random() < 0.5 else t)
        if x < 0.96:
            return tag("table", "".join(tag("tr", "".join(tag("td", _words(r, 3)) for _ in range(3))) for _ in range(r.randint(1, 4))))
        return tag("div", t) if r.random() < 0.6 else tag("pre", t)

    def marked(x):
        return re.sub(r"(^|>)([^<]*[^<\s])", "\\1\x01\\2", x)

    title = tag("h1", _words(r, r.randint(1, 10)))
    title = tag("header", marked(title)) if r.random() < 0.15 else marked(title)
    def inner():
        """A block of main text, or now and then text that stands beside the blocks."""
        if r.random() < 0.06:
            return "\x01" + _words(r, r.randint(8, 60)) + r.choice(["", "<br>"])
        return marked(block())

    body = "".join(inner() + (noise() if r.random() < 0.04 else "") for _ in range(r.choice([0, 1, 1, 2, 4, 8, 20, 20, 60])))
    x = r.random()
    if x < 0.5:
        main = tag("article", title + body, r.choice(["", "", cls("post", "story")]))
    elif x < 0.65:
        main = tag("main", title + body)
    elif x < 0.9:
        main = tag("div", title + body, cls("content", "post-body", "entry-content", "article", "story", "main-content", "text"))
    else:
        main = tag("div", title + body)
    if r.random() < 0.35:  # elements around the main one, with lines of their own
        around = [loose() if r.random() < 0.3 else "", loose() if r.random() < 0.2 else ""]
        main = tag("div", around[0] + main + around[1], r.choice(["", cls("page", "container", "wrap", "content", "main")]))
    before = [menu() for _ in range(r.randint(0, 2))] + [noise() for _ in range(r.randint(0, 2))]
    if r.random() < 0.35:
        before.insert(0, tag("header", tag("h1", _words(r, 2)) + menu()) if r.random() < 0.6 else tag("div", _words(r, 3), cls("header", "masthead")))
    after = [noise() for _ in range(r.randint(0, 3))] + ([comments()] if r.random() < 0.3 else [])
    if r.random() < 0.85:
        t = "&copy; " + _words(r, r.randint(1, 15)) + (link() if r.random() < 0.5 else "")
        after.append(tag("footer", t if r.random() < 0.6 else tag("p", t)) if r.random() < 0.7 else tag("div", t, cls("footer", "copyright")))
    if r.random() < 0.25:
        before.insert(r.randint(0, len(before)), loose())
    if r.random() < 0.2:
        after.insert(r.randint(0, len(after)), loose())
    return "<html><body>" + "".join(before) + main + "".join(after) + "</body></html>"


@lru_cache(maxsize=2)
def trained(pages: int = TRAIN_PAGES, seed: int = SEED) -> Boosted:
    r = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        root, texts = parse(page(r))
        for n, t in texts:
            if "\x01" in t:
                while n:
                    n.truth, n = True, n.parent
        nodes, rows, _ = features(root, [(n, t.replace("\x01", "")) for n, t in texts])
        xs.append(rows)
        ys.append([n.truth for n in nodes])
    return Boosted().fit(np.concatenate(xs), np.concatenate(ys).astype(float))


def batches(pages: list[str]) -> list[list[str]]:
    """Runs of pages of about BATCH characters, at least one in each."""
    out, size = [], BATCH
    for p in pages:
        if size >= BATCH:
            out.append([])
            size = 0
        out[-1].append(p)
        size += len(p)
    return out


def extract(model: Boosted, pages: list[str]) -> list[str]:
    """The main text of each page; pages are scored together."""
    parsed = [(*parse(p), None) for p in pages]
    feats = [features(root, texts) for root, texts, _ in parsed]
    if not feats:
        return []
    margin = model.margin(np.concatenate([x for _, x, _ in feats]))
    out, at = [], 0
    for (_, texts, _), (nodes, x, parent) in zip(parsed, feats, strict=True):
        n = len(nodes)
        weight = 1.0 + x[:, 20]
        keep = decode(margin[at : at + n], parent, weight)
        out.append("\n".join(t for node, t in texts if keep[node.order]))
        at += n
    return out


def extracted(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per input row: page_id, the columns of keep, text, n_chars (code points).

    Null and empty pages, and pages without main text, give an empty text.  Repeated rows are
    alike.  Broken markup is read as far as it goes: open elements end with their parent, a tag
    that never ends ends the page.  An empty table gives an empty result; columns that are not
    named are not read, and keep may not name text or n_chars.
    """
    prepare(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(trained())
    names = [id_col, *keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*names).schema.fields)

    def each(it):
        m = sent.value
        for b in it:
            texts = [t for part in batches([x or "" for x in b.column(len(names)).to_pylist()]) for t in extract(m, part)]
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(names))], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    return pages.select(*names, html_col).mapInArrow(each, schema + ", text string, n_chars long")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
