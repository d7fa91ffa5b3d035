"""8. HTML main text by composite text density.

Every element gets its characters per tag, adjusted for link text; the element
with the largest sum of its children's densities is found, and the smallest
density on its path up to the body is the threshold. On that path an ancestor
with more than one child above the threshold is taken whole; of one without,
the other children that are mostly unlinked text blocks (a headline, a lead, a
second article) join in. An article or main tag only speaks for an ancestor.
Elements that are boilerplate by their tag,
role or class take no part; a role or class that would take most of the page's
text marks a wrapper, not boilerplate, and its elements stay.

Defined results: null and empty html give empty text; html without tags is one
block; unclosed and stray tags are closed as browsers do; equal rows get equal
texts; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm import common as C

#: Quotes delimit a value behind an equals sign only; no part is tried twice.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>|<[!?][^>]*+>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = re.compile(r"</(script|style|title|textarea|iframe|noscript)\s*>", re.I)  # what ends them is found by text alone
RAW = frozenset("script style noscript template textarea title iframe svg math select option button".split())
SECTIONS = frozenset("nav header footer aside dialog menu".split())  # looked at if no text is left without them
CONTROLS = frozenset(["label", "legend"])
DROP = SECTIONS | frozenset(["head"]) | RAW
BLOCK = frozenset(
    "address article blockquote body br center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li "
    "form main ol p pre section summary table tbody td tfoot th thead tr ul".split()) | DROP
#: An element of the key is closed by a tag of the value's set.
P_ENDS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
                   "section table ul".split())
ENDS = {"p": P_ENDS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
        "tr": frozenset(["tr", "tbody"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
        "option": frozenset(["option"])}
CLOSING = frozenset().union(*(ENDS[k] for k in ENDS if k != "p"))
#: Words of a class, id or role that mark boilerplate.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "disqus dialog footer gdpr masthead menu menubar modal nav navbar navigation newsletter notice popup promo promoted related reply "
    "replies respond share sharing sidebar skip social sponsor sponsored subscribe toolbar widget complementary contentinfo search "
    "disclaimer alert".split())
#: Of those, words of elements that stand beside an article however long they are.
BESIDE = frozenset("comment comments commentlist consent cookie cookies disqus gdpr modal newsletter popup reply replies respond subscribe "
                   "disclaimer".split())
#: A piece of text by its tag, which a lone line in a div is not.
TEXT_BLOCKS = frozenset("article blockquote dl figure h1 h2 h3 h4 h5 h6 main ol p pre section table ul".split())
WITHOUT = frozenset("has no with without".split())  # class='has-sidebar' marks no sidebar
ARTICLE_CHARS = 200  # of an article or main element that stands beside all marked ones, or of marked ones that may be wrappers
PART = re.compile(r"[a-z]+|[A-Z][a-z]*")
SPACE = re.compile(r"[ \t\n\x0b\x0c\r]+")


class Node:
    __slots__ = ("tag", "up", "items", "marks", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, up: Node | None, marks: frozenset[str] = frozenset()):
        self.tag, self.up, self.items = tag, up, []  # items: texts and nodes, in page order
        self.marks = marks
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


GONE = frozenset(["gone"])  # never shown as text
SECTION = frozenset(["section"])


def marks_of(tag: str, attributes: str) -> frozenset[str]:
    """Why an element may be boilerplate: GONE, SECTION or words of MARKS."""
    if tag in SECTIONS:
        out = SECTION
    elif tag in DROP or tag in CONTROLS:
        return GONE
    else:
        out = frozenset(["form"]) if tag == "form" else frozenset()
    if "=" not in attributes and "hidden" not in attributes or tag in ("body", "html", "article", "main"):
        return out
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return GONE
        if name == "style":
            if re.search(r"display\s*:\s*none", value):
                return GONE
        elif name != "aria-hidden" and out is not SECTION:
            words = [w.lower() for w in PART.findall(value)]
            found = [w for before, w in zip(["", *words], words) if w in MARKS and before not in WITHOUT]
            if found:
                out = out.union(found)
    return out


class Open:
    """The place in the tree, and how many elements of a tag are open, so that
    no end tag walks up for what is not there: in all, since the innermost
    boilerplate element (an inline end tag does not reach out of one), and, of
    paragraphs, since the innermost element that a start tag looks up to."""

    FENCES = frozenset("article body div section td li".split())

    def __init__(self, root: Node):
        self.at = root
        self.all: Counter = Counter()
        self.inner: list[Counter] = [Counter()]
        self.paragraphs = [0]

    def push(self, node: Node) -> None:
        self.at = node
        self.all[node.tag] += 1
        if node.marks:
            self.inner.append(Counter())
        self.inner[-1][node.tag] += 1
        if node.marks or node.tag in self.FENCES:
            self.paragraphs.append(0)
        self.paragraphs[-1] += node.tag == "p"

    def pop(self) -> None:
        node, self.at = self.at, self.at.up
        self.all[node.tag] -= 1
        self.inner[-1][node.tag] -= 1
        if node.marks:
            self.inner.pop()
        self.paragraphs[-1] -= node.tag == "p"
        if node.marks or node.tag in self.FENCES:
            self.paragraphs.pop()

    def close(self, tag: str) -> bool:
        """Ends the innermost open element of a tag and all inside."""
        if not (self.all if tag in BLOCK else self.inner[-1])[tag]:
            return False
        while self.at.tag != tag:
            self.pop()
        self.pop()
        return True


def parse(page: str) -> Node:
    """The tree of the page without boilerplate elements."""
    root = Node("#root", None)
    open_, here, n, marked = Open(root), 0, len(page), False
    last = page.rfind(">")
    while here < n:
        m = TOKEN.search(page, here) if here <= last else None
        if not m:
            comment = page.find("<!--", here)  # one that does not end
            open_.at.items.append(page[here:] if comment < 0 else page[here:comment])
            break
        if m.start() > here:
            open_.at.items.append(page[here:m.start()])
        here = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if not open_.close(tag) and tag == "p":
                open_.at.items.append(Node("p", open_.at))
            continue
        if tag in ("script", "style", "title", "textarea", "iframe", "noscript"):
            end = next((x for x in UNREAD.finditer(page, here) if x[1].lower() == tag), None)
            here = end.end() if end else n
            open_.at.items.append(Node(tag, open_.at))  # a break between blocks
            continue
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            open_.at.items.append(Node(tag, open_.at))
            continue
        if tag in P_ENDS and open_.paragraphs[-1]:
            while open_.at.tag != "p":
                open_.pop()
            open_.pop()
        if tag in CLOSING:
            node = open_.at
            while node.up is not None and node.tag not in BLOCK:
                node = node.up
            if node.tag in ENDS and tag in ENDS[node.tag]:
                while open_.at is not node:
                    open_.pop()
        while open_.at.tag in ENDS and tag in ENDS[open_.at.tag]:
            open_.pop()
        if tag in ("article", "main") and (open_.at.marks is GONE or open_.at.marks is SECTION):
            open_.pop()  # never closed
        marks = marks_of(tag, m[3])
        marked = marked or bool(marks)
        open_.at.items.append(node := Node(tag, open_.at, marks))
        open_.push(node)
    if marked:
        prune(root)
    return root


def cut(nodes: list[Node]) -> None:
    """Leaves a break between blocks, or nothing, of each element."""
    for node in nodes:
        node.items = []
        if node.tag not in BLOCK:
            node.tag = "span"


def texts_of(root: Node) -> None:
    """link_chars of every node: its characters; chars: those that are no link's."""
    for node in reversed(in_order(root)):
        for x in node.items:
            if type(x) is str:
                n = len("".join(x.split()))
                node.chars += n
                node.link_chars += n
            else:
                node.chars += x.chars
                node.link_chars += x.link_chars
        if node.tag == "a":
            node.chars = 0


def outermost(root: Node) -> tuple[list[Node], list[Node]]:
    """The outermost marked nodes, and the nodes outside of them."""
    marked, free = [], [root]
    for node in free:
        for x in node.items:
            if type(x) is Node:
                (marked if x.marks else free).append(x)
    return marked, free


def prune(root: Node) -> None:
    """Cuts the boilerplate elements. Marks that take more text than they leave
    are not trusted: an element that holds most of the text itself stays, and
    its descendants are judged for themselves; else all those of the word that
    takes most stay. Comments and the like may be longer than an article and
    stay only if next to nothing else is there."""
    cut([x for x in in_order(root) if x.marks is GONE])
    texts_of(root)
    marked, free = outermost(root)
    whole = False  # an article stands outside of the marked elements
    while True:
        whole = whole or any(is_whole(x) for x in free if x.tag in ("article", "main"))
        marked = [x for x in marked if x.link_chars]
        left = root.link_chars - sum(x.link_chars for x in marked)
        plain = [x for x in marked if x.marks is not SECTION and x.chars]
        doubted = [x for x in plain if not x.marks & BESIDE]
        if (most := sum(x.chars for x in doubted)) <= left or left and most < ARTICLE_CHARS:
            doubted = plain if sum(x.chars for x in plain) > 20 * left else [] if left else marked
        if whole or not doubted:
            break
        held = left + sum(x.chars for x in doubted)
        stay = [x for x in doubted if 2 * x.chars > held]
        if not stay:
            sums: dict[str, int] = {}
            for x in doubted:
                for w in x.marks:
                    sums[w] = sums.get(w, 0) + x.chars
            word = max(sums, key=lambda w: (sums[w], w))
            stay = [x for x in doubted if word in x.marks]
        free = []
        for x in stay:
            x.marks = frozenset()
            inner, outer = outermost(x)
            marked += inner
            free += outer
        marked = [x for x in marked if x.marks]
    cut([x for x in in_order(root) if x.marks])


def is_whole(node: Node) -> bool:
    """Whether an article has text of its own: all of it, or enough."""
    mine = node.chars - sum(x.chars for x in outermost(node)[0])
    return 0 < mine and (mine == node.chars or mine >= ARTICLE_CHARS)


def in_order(root: Node) -> list[Node]:
    """All nodes, parents before children (no recursion: pages nest deeply)."""
    out = [root]
    for node in out:
        out += [x for x in node.items if type(x) is Node]
    return out


def weigh(nodes: list[Node]) -> None:
    for node in reversed(nodes):
        node.chars = node.link_chars = 0
        for x in node.items:
            if type(x) is str:
                node.chars += len("".join(x.split()))
            else:
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
    body = nodes[0]
    b_chars, b_links = max(body.chars, 1), body.link_chars
    for node in nodes:
        if not node.chars:
            continue
        c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        base = math.log(c / max(c - lc, 1) * lc + b_links / b_chars * c + math.e)
        # the argument is kept at 1 or more: no density is negative
        node.density = c / t * math.log(max(c / lc * t / lt, 1.0), base)
    for node in nodes:
        node.total = sum(x.density for x in node.items if type(x) is Node)


def article(root: Node) -> list[Node]:
    """The subtrees that hold the main text, in page order: the one of the
    largest sum, and going up from it to the body either the whole ancestor or
    those of its other children that are text as well."""
    nodes = in_order(root)
    weigh(nodes)
    textual: set[int] = set()  # nodes with a text block inside
    for node in reversed(nodes):
        if node.tag in TEXT_BLOCKS or any(type(x) is Node and id(x) in textual for x in node.items):
            textual.add(id(node))
    body = next((x for x in nodes if x.tag == "body"), root)
    top = max(in_order(body), key=lambda x: x.total)
    if not top.total:
        return [body]
    limit, node = top.density, top
    while node is not body and node.up is not None:
        limit = min(limit, node.density)
        node = node.up
    limit = min(limit, body.density)
    def children(node: Node) -> tuple[list[Node], list[bool]]:
        """With text inside, and which of them are text by the threshold or by
        their blocks."""
        inner = [x for x in node.items if type(x) is Node and x.chars]
        return inner, [x.density >= limit or 2 * x.link_chars < x.chars and id(x) in textual for x in inner]

    parts, node = [top], top
    while node is not body and node.up is not None:
        child, node = node, node.up
        inner, text = children(node)
        # an ancestor takes over if text stands there beside the densest child:
        # more than one of its children reaches the threshold, or it is an article
        if (node.tag in ("article", "main") or sum(x.density >= limit for x in inner) > 1
                or any(type(x) is str and x.strip() for x in node.items)):
            parts = [node]
        else:
            at = inner.index(child)
            parts = ([x for x, t in zip(inner[:at], text) if t and 2 * x.link_chars < x.chars] + parts
                     + [x for x, t in zip(inner[at + 1:], text[at + 1:]) if t and 2 * x.link_chars < x.chars])
    if parts == [body] and not any(type(x) is str and x.strip() for x in body.items):
        inner, text = children(body)  # lone lines in front of all text and behind are none of it
        if any(text):
            parts = inner[text.index(True):len(text) - text[::-1].index(True)]
    return parts


def blocks(node: Node) -> Iterator[str]:
    """Texts of the blocks of a subtree in page order."""
    run: list[str] = []
    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            pass
        elif type(x) is str:
            run.append(x)
            continue
        elif x.tag in BLOCK:
            stack.append(None)
            stack.extend(reversed(x.items))
        else:
            stack.extend(reversed(x.items))
            continue
        yield "".join(run)
        run = []
    yield "".join(run)


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = (SPACE.sub(" ", entities.unescape(b)).strip(" ") for part in article(parse(page)) for b in blocks(part))
    return " ".join(b for b in found if b)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    src = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return src.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op8 over all pages."""
    return extract(C.table(spark, sf_dir, "pages"))
