"""Main text of web pages by site style trees.

Pages of one host are merged into a style tree: an element node is a place in
the page (the path of tags and classes from the root), and under it stand the
styles, i.e. sequences of children, with which the pages present it, and the
contents (hashed texts) that the pages have there.

* The presentation importance of an element node is the entropy of its styles
  over its occurrences, as a share of the largest possible entropy: nodes that
  look the same everywhere carry little.
* The content importance of a text is 1 - log(c) / log(m) for a text that
  c of the m pages with that node share: text that all pages repeat is noise.

A node's importance is what the tree says of it, trusted the more the more
pages have the node, and otherwise what markup says: text in an article or main
element is likely content.  A node's composite importance mixes its own with
that of its children, with a discount per child.  A branch is removed if it
and everything in it is below the threshold.  Menus, adverts, comments and the
like often differ from page to page, so no entropy can tell them from content:
``nav``, ``footer``, ``form``, class words such as ``ad`` and similar markup
remove a branch by themselves.  Where a page has an article, unmarked branches
outside count only if the tree finds them important and they hold more text.

Copies of a page under other ids or URLs of its host (equal nodes with equal
texts) count as one page.  Statistics are sums over pages, so a host with a
third of all pages is folded in each scan task.  Pages themselves are not
shuffled to be joined with them: importances are decided on the nodes' hashes,
and only pages that lose a branch are looked up (broadcast up to a counted
size, joined beyond).

Defined results: a null or empty page has no text; of a host with one page
every node counts as content unless the markup says otherwise; unclosed and
stray tags are repaired as browsers do for the tags used here, and a tag that
never ends is closed where the next one starts, so that work is linear in the
length of a page; repeated rows are extracted one by one; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.workspace import drop_tables, materialise

THRESHOLD = 0.35
DISCOUNT = 0.9
#: What the style tree counts at most against markup, and pages of a node that give it half of that.
TRUST, HALF = 0.7, 4
#: What markup says of nodes in an article, of nodes beside one, and of pages without any.
INSIDE, BESIDE, OPEN = 1.0, 0.2, 0.6
#: Pages that lose a branch and are broadcast, at most, and their branches.
BROADCAST_ROWS = 200_000

# Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math canvas object select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY_SAME = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table tbody thead tfoot", "td": "tr table", "th": "tr table", "option": "select"}
NOISE_TAGS = frozenset("head nav header footer aside form button dialog menu script style noscript template iframe svg math canvas object select textarea".split())
MAIN_TAGS = frozenset("article main".split())
NOISE_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus
    footer header hidden login masthead menu menubar modal nav navbar navigation newsletter notice pagination pager popup promo promoted
    related recommended replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget""".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form".split())

_TAG_NAME = re.compile(r"/?[a-zA-Z][^\s/<>]*")
_TAG_STOP = re.compile(r"[<>\"']")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PART = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Node:
    """An element: its tag with classes, prior (0 noise, 1 main, None open), children (nodes and texts)."""

    tag: str
    label: str
    prior: float | None = None
    children: list[Node | str] = field(default_factory=list)


def _node(tag: str, raw: str) -> Node:
    attributes = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(raw)} if raw and not raw.isspace() else {}
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()
    label = ".".join([tag, *sorted(attributes.get("class", "").split())])
    prior = None
    if tag in NOISE_TAGS or "hidden" in attributes or attributes.get("role", "").lower() in NOISE_ROLES or attributes.get("aria-hidden") == "true":
        prior = 0.0
    elif "display:none" in attributes.get("style", "").replace(" ", "").lower():
        prior = 0.0
    elif tag not in ("html", "body") and any(NOISE_WORDS.intersection(_NAME_PART.findall(n)) for n in names):
        prior = 0.0
    elif tag in MAIN_TAGS or attributes.get("role", "").lower() == "main" or attributes.get("itemprop") == "articleBody":
        prior = 1.0
    return Node(tag, label, prior)


def _tag_end(page: str, at: int, unclosed: set[str]) -> tuple[int, int]:
    """Where the attributes of a tag end and where the page goes on; ``unclosed``: quotes that never close any more."""
    while True:
        found = _TAG_STOP.search(page, at)
        if not found:
            return len(page), len(page)
        at, mark = found.start(), found[0]
        if mark == ">":
            return at, at + 1
        if mark == "<":
            return at, at
        at += 1
        if mark not in unclosed and page[max(0, at - 9) : at - 1].rstrip().endswith("="):
            close = page.find(mark, at)
            if close < 0:
                unclosed.add(mark)
            else:
                at = close + 1


class _Stack:
    """Open elements, with the places of each tag, so that every step costs what it pops."""

    def __init__(self, root: Node) -> None:
        self.nodes = [root]
        self.block = [0]  # place of the nearest element that is not inline
        self.places: dict[str, list[int]] = {}
        self.main: list[int] = []

    def push(self, node: Node) -> None:
        at = len(self.nodes)
        self.nodes.append(node)
        self.block.append(self.block[-1] if node.tag in INLINE else at)
        self.places.setdefault(node.tag, []).append(at)
        if node.prior == 1.0:
            self.main.append(at)

    def cut(self, at: int) -> None:
        """Closes everything from place ``at``."""
        while len(self.nodes) > at:
            node = self.nodes.pop()
            self.block.pop()
            self.places[node.tag].pop()
            if node.prior == 1.0:
                self.main.pop()

    def last(self, *tags: str) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)


def parse(page: str) -> Node:
    """The tree of a page."""
    root = Node("#", "#")
    stack, at, end = _Stack(root), 0, len(page)
    unclosed: set[str] = set()
    while at < end:
        start = page.find("<", at)
        if start < 0:
            stack.nodes[-1].children.append(page[at:])
            break
        if start > at:
            stack.nodes[-1].children.append(page[at:start])
        after = page[start + 1 : start + 9]
        if after.startswith(("!", "?")):
            mark = "-->" if after.startswith("!--") else "]]>" if after.startswith("![CDATA[") else ">"
            close = page.find(mark, start + 2)
            at = end if close < 0 else close + len(mark)
            continue
        name = _TAG_NAME.match(page, start + 1)
        if not name:
            stack.nodes[-1].children.append("<")
            at = start + 1
            continue
        stop, at = _tag_end(page, name.end(), unclosed)
        tag = name[0].lower()
        if tag.startswith("/"):
            tag = tag[1:]
            place = stack.last(tag)
            if place and (tag in INLINE or tag in ("p", "li") or not stack.main or stack.main[-1] <= place):
                stack.cut(place)
            continue
        if tag in CLOSES_P and stack.nodes[stack.block[-1]].tag == "p":
            stack.cut(stack.block[-1])
        if tag in CLOSED_BY_SAME:
            place = stack.last("dt", "dd") if tag in ("dt", "dd") else stack.last(tag)
            if place > stack.last(*CLOSED_BY_SAME[tag].split()):
                stack.cut(place)
        raw = page[name.end() : stop]
        node = _node(tag, raw)
        stack.nodes[-1].children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else end
        elif tag not in VOID and not raw.endswith("/"):
            stack.push(node)
    return root


def blocks(node: Node, wanted) -> list[str]:
    """Texts of blocks in page order; ``wanted(node)`` says whether a branch is entered."""
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(run))).strip()
        if text:
            out.append(text)
        run.clear()

    stack: list = [iter(node.children)]
    ends: list[bool] = [True]
    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
            if ends.pop():
                close()
        elif isinstance(child, str):
            run.append(child)
        elif child.tag == "br":
            run.append(" ")
        elif child.tag not in VOID and wanted(child):
            block = child.tag not in INLINE
            if block:
                close()
            stack.append(iter(child.children))
            ends.append(block)
    return out


@dataclass(slots=True)
class Element:
    """A style-tree node of a page: its place in the list of its parent, the hash of its path, and whether it is in an article."""

    node: Node
    parent: int
    path: int
    inside: bool


def elements(root: Node) -> list[Element]:
    """Style-tree nodes of a page, parents first; inline elements belong to their block, and noise has no nodes."""
    out = [Element(root, -1, xxhash.xxh64_intdigest(root.label), False)]
    at = 0
    while at < len(out):
        own = out[at]
        for child in own.node.children:
            if isinstance(child, Node) and child.prior != 0.0 and child.tag not in VOID and child.tag not in INLINE:
                out.append(Element(child, at, xxhash.xxh64_intdigest(child.label, seed=own.path), own.inside or child.prior == 1.0))
        at += 1
    return out


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def features(node: Node) -> tuple[int, int]:
    """Hash of the node's style (labels of its children) and of its own text."""
    style = " ".join(c.label for c in node.children if isinstance(c, Node) and c.tag not in INLINE)
    inside = Node(node.tag, node.label, None, [c for c in node.children if isinstance(c, str) or c.tag in INLINE])
    own = " ".join(blocks(inside, lambda n: n.tag in INLINE))
    return _signed(xxhash.xxh64_intdigest(style)), _signed(xxhash.xxh64_intdigest(own)) if own else 0


def host_of(url: str | None) -> str:
    return re.sub(r"^[a-z]+://", "", url or "", flags=re.I).split("/")[0].split("?")[0].split("#")[0].lower()


_NODE = "k int, parent int, inside boolean, path long, style long, content long"
_FEATURES = f"row long, host string, doc long, nodes array<struct<{', '.join(x.replace(' ', ':') for x in _NODE.split(', '))}>>"


def style_features(pages: DataFrame) -> DataFrame:
    """The style-tree nodes of each page; copies within a host have the same doc."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
        for batch in batches:
            columns: list[list] = [[] for _ in kinds]
            hosts, docs, offsets = [], [], [0]
            for url, page in zip(batch.column(1), batch.column(2), strict=True):
                found = [(k, e.parent, e.inside, _signed(e.path), *features(e.node)) for k, e in enumerate(elements(parse(page.as_py() or "")))]
                hosts.append(host_of(url.as_py()))
                docs.append(_signed(xxhash.xxh64_intdigest(repr(found))))
                for values in found:
                    for column, value in zip(columns, values, strict=True):
                        column.append(value)
                offsets.append(len(columns[0]))
            struct = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in _NODE.split(", ")])
            nodes = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hosts, pa.string()), pa.array(docs, pa.int64()), nodes], ["row", "host", "doc", "nodes"])

    return pages.select("row", "url", "html").mapInArrow(work, _FEATURES)


def importances(found: DataFrame) -> DataFrame:
    """(host, doc, nodes) of each distinct page: its nodes with their presentation and content importance and pages."""
    place = ["host", "path"]
    pages = materialise(found.dropDuplicates(["host", "doc"]).drop("row"), "distinct-pages")
    node = pages.select("host", "doc", F.explode("nodes").alias("node")).select("host", "doc", "node.*")
    styles = node.groupBy(*place, "style").agg(F.count("*").alias("c"))
    weight = styles.groupBy(*place).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("clogc"))
    look = F.when(F.col("n") > 1, (F.log("n") - F.col("clogc") / F.col("n")) / F.log("n")).otherwise(F.lit(1.0))
    # Of texts, pages are counted: a page has a text or a place once, however often it shows it.
    places = F.array_distinct(F.transform("nodes", lambda x: x["path"]))
    held = pages.select("host", F.explode(places).alias("path")).groupBy(*place).agg(F.count("*").alias("m"))
    presentation = materialise(weight.select(*place, look.alias("look")).join(held, place), "presentation")
    said = F.array_distinct(F.transform(F.filter("nodes", lambda x: x["content"] != 0), lambda x: F.struct(x["path"].alias("path"), x["content"].alias("content"))))
    texts = pages.select("host", F.explode(said).alias("t")).groupBy("host", "t.path", "t.content").agg(F.count("*").alias("c"))
    texts = materialise(texts.where("c > 1"), "contents")
    joined = node.join(presentation, place).join(texts, [*place, "content"], "left")
    share = F.coalesce("c", F.lit(1)) / F.lit(1.0)
    content = F.when(F.col("content") == 0, F.lit(None).cast("double")).when(F.col("m") > 1, 1 - F.log(share) / F.log("m")).otherwise(F.lit(1.0))
    return joined.groupBy("host", "doc").agg(F.collect_list(F.struct("k", "parent", "inside", "m", "look", content.alias("said"))).alias("nodes"))


def removed(nodes: list[dict]) -> list[int] | None:
    """The nodes (k) of a page whose branch is below the threshold with everything in it; of nested ones the outermost.

    None if there are none and no important text stands beside an article: then markup alone gives the text.
    """
    nodes = sorted(nodes, key=lambda n: n["k"])
    frame = any(n["inside"] for n in nodes)
    score, noise = [0.0] * len(nodes), [True] * len(nodes)
    children: list[list[int]] = [[] for _ in nodes]
    for k in range(len(nodes) - 1, -1, -1):
        n, below = nodes[k], children[k]
        trust = TRUST * n["m"] / (n["m"] + HALF)
        markup = INSIDE if n["inside"] else BESIDE if frame else OPEN
        text = n["said"] is not None
        own = trust * (n["said"] if text else n["look"]) + (1 - trust) * markup
        if below:
            rest = DISCOUNT ** len(below)
            score[k] = (1 - rest) * own + rest * sum(score[c] for c in below) / len(below)
            score[k] = max(score[k], own) if text else score[k]
        else:
            score[k] = own if text else 0.0
        noise[k] = score[k] < THRESHOLD and all(noise[c] for c in below)
        if k:
            children[n["parent"]].append(k)
    gone = [k for k, n in enumerate(nodes) if noise[k] and (k == 0 or not noise[n["parent"]]) and (n["said"] is not None or children[k])]
    beside = frame and any(n["said"] is not None and not n["inside"] and not noise[k] for k, n in enumerate(nodes))
    return gone if gone or beside else None


def main_text(page: str, gone: list[int] | None = None) -> str:
    """The text of a page after the removal of the branches ``gone``."""
    root = parse(page)
    found = elements(root)
    away = {id(found[k].node) for k in gone or ()}
    enter = lambda n: n.prior != 0.0 and id(n) not in away
    inside = [e.node for e in found if e.inside and not (e.parent >= 0 and found[e.parent].inside)]
    if not inside:
        return "\n".join(blocks(root, enter)) if id(root) not in away else ""
    article = "\n".join(b for n in inside if _reached(n, found, away) for b in blocks(n, enter))
    if gone is None:
        return article
    # The tree has seen the pages' frame: what it leaves beside the article may be the longer text.
    mains = {id(n) for n in inside}
    beside = "\n".join(blocks(root, lambda n: enter(n) and id(n) not in mains)) if id(root) not in away else ""
    return "\n".join(blocks(root, enter)) if len(beside) > len(article) else article


def _reached(node: Node, found: list[Element], away: set[int]) -> bool:
    """Whether no branch around ``node`` is removed."""
    if not away:
        return True
    at = next(k for k, e in enumerate(found) if e.node is node)
    while at >= 0:
        if id(found[at].node) in away:
            return False
        at = found[at].parent
    return True


def changes(rows: DataFrame) -> DataFrame:
    """(row, gone): the branches that the style tree removes, of pages that lose any or may have their text beside an article."""
    found = materialise(style_features(rows), "styles")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [removed(n) for n in batch.column(2).to_pylist()]
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gone, pa.list_(pa.int32()))], ["host", "doc", "gone"])
            yield out.filter(pa.array([g is not None for g in gone], pa.bool_()))

    known = importances(found)
    lost = materialise(known.mapInArrow(decide, "host string, doc long, gone array<int>"), "lost")
    out = materialise(found.select("row", "host", "doc").distinct().join(lost, ["host", "doc"]).select("row", "gone").dropDuplicates(["row"]), "gone")
    drop_tables(found, known, lost)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of (page_id, url, html)."""
    base = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    rows = base.withColumn("row", F.xxhash64("url", "html"))  # equal pages have equal text
    gone = changes(rows)
    size = gone.agg(F.coalesce(F.sum(F.size("gone") + 1), F.lit(0))).first()[0]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py() or "", cut.as_py()) for page, cut in zip(batch.column("html"), batch.column("gone"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    joined = rows.join(F.broadcast(gone) if size <= BROADCAST_ROWS else gone, "row", "left").select("page_id", "url", "html", "gone")
    return joined.mapInArrow(work, "page_id long, url string, text string, n_chars long")
