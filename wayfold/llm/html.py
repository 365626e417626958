"""Main text of web pages by tree scoring.

The page becomes a tree of elements. Every block with text of its own passes points (for
length and commas) to its ancestors, fewer the further up; a container's points are
discounted by its share of link text. The best container is kept, and those of its siblings
that look like content. Elements that are never content (menus, forms, comments of readers,
and what their class names say is boilerplate) are left out, but for those that hold the
article or, where only a class name speaks, most of the text. Where the page marks an
article (or else its main part), containers outside it are not considered.

A page is read once from start to end, whatever its markup, and no step recurses.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of HTML elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("head nav footer aside noscript template button select svg math canvas audio video object menu dialog".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre "
    "section summary table tbody thead tfoot tr caption ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("div section article main body html td form".split())
ARTICLES = frozenset(["article", "main"])
#: Elements beside the main part: an article in one of them is a teaser if any stands elsewhere.
BESIDE = frozenset("nav footer aside menu dialog".split())
#: Elements that a start tag ends, if they are open within the nearest of its limits.
ENDS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "tbody": "thead tbody tr td th", "tfoot": "tbody tr td th"}
LIMITS = frozenset("table ul ol dl select div article section body html aside nav footer main".split())
LISTS = LIMITS - {"div"}

NAMED = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
NAME = re.compile(r"[A-Za-z][^\s/>]*")
#: What ends a tag, or opens a quoted value within it.
DELIMITER = re.compile(r">|=\s*([\"'])")
PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
# Words of class names: boilerplate (at the start or end of a name), readers' comments, and
# words that turn a name into one about the layout.
BOILER = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promos promotion banner cookie cookies consent gdpr notice notices alert alerts sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs topbar masthead footer social share sharing disqus respond newsletter subscribe subscription signup login popup modal overlay widget widgets pagination pager toolbar copyright".split()
)
COMMENTS = frozenset("comment comments commentlist commentform reply replies disqus kommentar kommentare commentaire commentaires comentario comentarios".split())
# Names that may be comments or a part of the article: comments if items in them have an author or a date.
TALK = frozenset("response responses discussion discussions thread threads feedback reaction reactions opinions talk guestbook conversation".split())
# Words of class names, and elements, that mark an author and a date.
AUTHORS = frozenset("author authors user username nickname nick byline avatar commenter poster by".split())
DATES = frozenset("date time timestamp datetime posted ago published when".split())
LISTED = frozenset("related recommended more".split())
LINKED = frozenset("posts post articles article stories story links content items news reading videos products entries".split())
LAYOUT = frozenset("has with without no non not free layout wrapper page main body content container enabled".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog".split())
GOOD = re.compile(r"article|content|post|entry|story|main|body|text|blog", re.I)
SPACE = re.compile(r"\s+")


class Node:
    """An element: its children and the text that stands between them."""

    __slots__ = ("above", "attributes", "beside", "commas", "good", "holds", "links", "marks", "name", "out", "parent", "parts", "points", "size", "total", "total_links", "within")

    def __init__(self, name: str, parent: Node | None, attributes: str = "") -> None:
        self.name, self.parent, self.attributes, self.parts = name, parent, attributes, []
        # The nearest block above, and whether an article stands above.
        self.above = None if parent is None else parent if parent.name in BLOCKS else parent.above
        self.within = parent is not None and (parent.within or parent.name in ARTICLES)
        self.beside = name in BESIDE or (parent is not None and parent.beside)
        self.size = self.links = self.commas = self.total = self.total_links = 0
        self.points, self.good, self.holds, self.out, self.marks = 0.0, False, False, False, 0


def spoken(attributes: str) -> tuple[bool, bool, bool, bool, bool, int]:
    """What attributes say: hidden, boilerplate by role or class name, readers' comments,
    content by class name, talk (comments perhaps), and marks of an author (1) and a date (2)."""
    hidden = boiler = comments = good = talk = False
    marks = 0
    for key, value in NAMED.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            hidden = True
        elif key == "role":
            boiler = boiler or value.lower() in ROLES
        elif key in ("class", "id"):
            good = good or GOOD.search(value) is not None
            for name in value.split():
                parts = [p.lower() for p in PARTS.split(name) if p]
                marks |= (not AUTHORS.isdisjoint(parts)) | 2 * (not DATES.isdisjoint(parts))
                if not parts or LAYOUT.intersection(parts):
                    continue
                ends = {parts[0], parts[-1]}
                comments = comments or not ends.isdisjoint(COMMENTS)
                talk = talk or not ends.isdisjoint(TALK)
                listed = parts[0] in LISTED and (len(parts) == 1 or parts[1] in LINKED)
                boiler = boiler or comments or not ends.isdisjoint(BOILER) or (listed and parts != ["more"]) or (parts[-1] == "header" and parts[0] == "site")
    return hidden, boiler, comments, good, talk, marks


class Tree:
    """Elements in the order of their start tags, and those that are open."""

    def __init__(self) -> None:
        self.nodes = [Node("html", None)]
        self.open = [self.nodes[0]]
        self.depths: dict[str, list[int]] = {"html": [0]}
        self.blocks = [0]

    def deepest(self, names) -> int:
        """Depth of the innermost open element of ``names``, or -1."""
        return max((self.depths[n][-1] for n in names if self.depths.get(n)), default=-1)

    def close(self, depth: int) -> None:
        """Ends all open elements from ``depth`` on; the root stays."""
        while len(self.open) > max(depth, 1):
            name = self.open.pop().name
            self.depths[name].pop()
            if name in BLOCKS:
                self.blocks.pop()

    def start(self, name: str, attributes: str) -> None:
        if name in BLOCKS and (p := self.deepest(("p",))) > self.deepest(LIMITS):
            self.close(p)
        if name in ENDS:
            names = ENDS[name].split()
            limit = self.deepest(LISTS if name in ("li", "dd", "dt") else ("table", "select"))
            first = min((d for n in names for d in self.depths.get(n, [])[-1:] if d > limit), default=-1)
            if first > 0:
                self.close(first)
        node = Node(name, self.open[-1], attributes)
        self.open[-1].parts.append(node)
        self.nodes.append(node)
        if name not in VOID and not attributes.endswith("/"):
            self.depths.setdefault(name, []).append(len(self.open))
            if name in BLOCKS:
                self.blocks.append(len(self.open))
            self.open.append(node)

    def end(self, name: str) -> None:
        """An end tag without its start is ignored; that of an inline element ends nothing
        beyond the block it stands in."""
        depth = self.deepest((name,))
        if depth > 0 and (name in BLOCKS or depth > self.blocks[-1]):
            self.close(depth)

    def text(self, text: str) -> None:
        self.open[-1].parts.append(text)


def parse(page: str) -> Tree:
    """Tree of all elements but scripts and the like. Unclosed elements end with their
    parents; a paragraph ends where a block begins. A tag without an end is dropped with
    what follows it; from a quote without an end on, quotes are ordinary characters."""
    tree, at, quotes = Tree(), 0, True
    while at < len(page):
        tag = page.find("<", at)
        if tag < 0:
            tree.text(page[at:])
            break
        if tag > at:
            tree.text(page[at:tag])
        ending = page.startswith("/", tag + 1)
        named = NAME.match(page, tag + 1 + ending)
        if named is None:
            if page.startswith("<!--", tag):
                close = page.find("-->", tag + 2)
                at = close + 3 if close >= 0 else len(page)
            elif page[tag + 1 : tag + 2] in ("!", "?", "/") and page[tag + 1 : tag + 2]:
                close = page.find(">", tag)
                at = close + 1 if close >= 0 else len(page)
            else:
                tree.text("<")
                at = tag + 1
            continue
        close = seen = named.end()
        while quotes:
            found = DELIMITER.search(page, seen)
            if found is None or found.group(1) is None:
                close = found.start() if found else -1
                break
            seen = page.find(found.group(1), found.end()) + 1
            if not seen:
                quotes = False
        if not quotes:
            close = page.find(">", named.end())
        if close < 0:
            if not quotes or page.find(">", tag) < 0:
                break
            quotes, close = False, page.find(">", tag)
        name, attributes, at = named.group().lower(), page[named.end() : close], close + 1
        if ending:
            tree.end(name)
        elif name in RAW:
            found = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = found.end() if found else len(page)
        elif name in VOID:
            if name in ("br", "hr"):
                tree.text(" ")
            if name in BLOCKS:
                tree.start(name, attributes)
        else:
            tree.start(name, attributes)
    return tree


def measure(nodes: list[Node]) -> None:
    """Sizes from the leaves up: ``size``, ``links``, ``commas`` of a block's own inline text,
    ``total`` and ``total_links`` of all text below; elements that are ``out`` count nothing."""
    for node in nodes:
        node.size = node.links = node.commas = node.total = node.total_links = 0
        for part in node.parts:
            if isinstance(part, str):
                node.size += len(SPACE.sub(" ", part).strip())
                node.commas += sum(map(part.count, ",،、，"))
        if node.name == "a":
            node.links = node.size
        node.total, node.total_links = node.size, node.links
    for node in reversed(nodes):
        up = node.parent
        if up is None or node.out:
            continue
        if node.name not in BLOCKS:
            up.size, up.commas = up.size + node.size, up.commas + node.commas
            up.links += node.size if up.name == "a" else node.links
        up.total += node.total
        up.total_links += node.total if up.name == "a" else node.total_links


def discussions(nodes: list[Node], said: list[tuple]) -> set[int]:
    """Numbers of the elements that are readers' comments by their structure: at least half
    of their text stands in like children (of one element and class, none an article), two or more of
    which each have an author and a date. With a name that fits, one child and one of both
    marks do."""
    for node, (*_, marks) in zip(nodes, said, strict=True):
        node.marks = marks | (node.name in ("cite", "address")) | 2 * (node.name == "time")
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.marks |= node.marks
    found = set()
    for k, (node, (*_, talk, _)) in enumerate(zip(nodes, said, strict=True)):
        if node.parent is None or node.name in ("html", "body") or node.name in ARTICLES or not (talk or node.marks == 3):
            continue
        like: dict[tuple[str, str], list[Node]] = {}
        for part in node.parts:
            if not isinstance(part, str) and (part.marks if talk else part.marks == 3) and (talk or part.name not in ARTICLES):
                like.setdefault((part.name, part.attributes.split("id=")[0]), []).append(part)
        items = max(like.values(), key=len, default=[])
        if len(items) >= (1 if talk else 2) and 2 * sum(x.total for x in items) >= node.total > 0:
            found.add(k)
    return found


def leave_out(nodes: list[Node]) -> None:
    """Marks what is never content as ``out``, with all below it."""
    said = [spoken(n.attributes) if n.attributes else (False,) * 5 + (0,) for n in nodes]
    measure(nodes)
    talk, whole = discussions(nodes, said), nodes[0].total
    # By structure alone only what is the smaller part of a page that marks its article.
    marked = any(n.name in ARTICLES for n in nodes)
    read = [s[2] or (k in talk and (s[4] or (marked and 2 * nodes[k].total < whole))) for k, s in enumerate(said)]
    inside = [False] * len(nodes)
    number = {id(n): k for k, n in enumerate(nodes)}
    for k, node in enumerate(nodes):
        inside[k] = read[k] or (node.parent is not None and inside[number[id(node.parent)]])
    for node, (_, _, _, good, _, _), comments in zip(nodes, said, inside, strict=True):
        node.good = node.name in ARTICLES or good
        node.holds = node.name in ARTICLES and not comments
    if any(n.holds and not n.beside for n in nodes):
        for node in nodes:
            node.holds = node.holds and not node.beside
    for node in reversed(nodes):
        if node.parent is not None and node.holds:
            node.parent.holds = True
    for node, (hidden, *_) in zip(nodes, said, strict=True):
        by_name = (node.name in DROPPED and not node.holds) or (node.name == "header" and not node.within and not node.holds)
        node.out = node.parent is not None and (node.parent.out or hidden or by_name)
    measure(nodes)
    # A class name alone does not drop most of a text, unless an article stands elsewhere.
    most = math.inf if nodes[0].holds else nodes[0].total / 2
    for node, (_, boiler, *_), comments in zip(nodes, said, read, strict=True):
        if node.parent is None or node.out:
            continue
        fixed = node.name in ("html", "body") or node.holds
        by_class = (boiler or comments) and not fixed and (comments or node.total < most) and (comments or node.name not in ARTICLES)
        node.out = node.parent.out or by_class or (node.name == "form" and not node.holds and node.total < most)
    measure(nodes)


def choose(tree: Tree) -> list[Node]:
    """The best container and the siblings that are kept, in page order."""
    nodes = tree.nodes
    leave_out(nodes)
    blocks = [n for n in nodes if not n.out and (n.name in BLOCKS or n.name in CONTAINERS)]
    for node in blocks:
        if not node.size:
            continue
        points = (1 + node.commas + min(node.size / 100, 3)) * (1 - node.links / node.size) * (0.5 if node.name in HEADINGS else 1)
        up = node if node.name in CONTAINERS else node.above
        for level in range(5):
            if up is None:
                break
            up.points += points / max(1, 2 * level)
            up = up.above
    rated = {id(n): n.points * (1 - n.total_links / max(1, n.total)) * (1.5 if n.good else 1) for n in blocks if n.points > 0}
    scored = [n for n in blocks if id(n) in rated]
    if not scored:
        return [nodes[0]]
    # What the page marks wins over all that stands outside: an article, else the main part.
    for name in ("article", "main"):
        marked = {id(n) for n in nodes if n.name == name and not n.out and not n.beside}
        for n in nodes if marked else []:
            if n.parent is not None and id(n.parent) in marked:
                marked.add(id(n))
        if own := [n for n in scored if id(n) in marked]:
            scored = own
            break
    best = max(scored, key=lambda n: rated[id(n)])
    top, up = rated[id(best)], best
    while up is not None and up.name not in ARTICLES:
        up = up.parent
    if up is not None:  # the page says itself where the article begins and ends
        best = up
    if best.parent is None:
        return [best]
    kept = []
    for part in best.parent.parts:
        if isinstance(part, str) or part.out:
            continue
        text = part.name in ("p", "pre", "blockquote") and part.size and part.links / part.size < 0.25
        likely = rated.get(id(part), 0) >= max(8.0, 0.25 * top)
        # Headings count that stand before the best container.
        if part is best or (part.name in HEADINGS and best not in kept) or (text or likely if best.name not in ARTICLES else likely and part.name == best.name):
            kept.append(part)
    return kept


def lines(node: Node) -> list[str]:
    """Text of each block below a node, in page order, in one line each."""
    found, current, stack = [], [], [node]

    def flush() -> None:
        text = " ".join(html.unescape("".join(current)).split())
        current.clear()
        if text:
            found.append(text)

    while stack:
        part = stack.pop()
        if part is None:
            flush()
        elif isinstance(part, str):
            current.append(part)
        elif part.out:
            current.append(" ")
        else:
            if part.name in BLOCKS:
                flush()
                stack.append(None)
            elif part.name in ("td", "th"):
                stack.append(" ")
            stack += reversed(part.parts)
    flush()
    return found


def main_text(page: str | None) -> str:
    """The main text of one page; empty for a null page or one without text."""
    if not page:
        return ""
    return "\n".join(line for node in choose(parse(page)) for line in lines(node))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every row of ``pages``.

    The whole ``html`` is read, whatever its length; a null page gives an empty text.
    Repeated rows are returned each, other columns are ignored, and an empty table gives
    an empty result.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(page.as_py()) for page in part.column(2)]
                sizes = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    picked = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return picked.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_html(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
