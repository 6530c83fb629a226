"""Main-text extraction from web pages.

Method: tree scoring. The page becomes a tree; boilerplate elements are pruned by tag, role and class name. Each paragraph
gives points for its length and its commas to its ancestors (all to the parent, half to the next, a third of that
half and so on further up); a candidate's sum is discounted by its link density. The best container is
widened to the article (or else main) element that it lies in, and kept whole without its boilerplate. Beside it stays, where no
article or main marks the bounds or a main does, all that isn't mostly links; beside a marked article, what scores well or reads like prose.

Where nothing readable is left, what was pruned by a mere class name, a form around the page or a menu without its end
tag holds the article: the pruned element with the most paragraphs is taken back, until something is.

The text keeps page order: one line per block, character references decoded, white space inside a block turned into
one space. One Arrow pass, no shuffle; memory is bounded by the largest page of a batch, and time by its length: elements
nested deeper than ``DEPTH`` stay flat.

Defined results: null or empty html, and pages without text, give an empty text of 0 characters; unclosed and truncated
markup is closed at the end; ties between containers go to the first; repeated rows are extracted each on its own; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import small

SCHEMA = "page_id long, url string, text string, n_chars long"

# Element names by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes template xmp svg annotation annotation-xml object".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
PRUNED = frozenset("nav header footer aside form menu button select option dialog head label input fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
PARAGRAPH = frozenset("p pre td blockquote dd li".split())
CLOSES_P = BLOCK - {"body", "html"}
# Elements that stand in head; what new items of lists and tables end, and where the search for these stops.
IN_HEAD = frozenset("base link meta title style script noscript template head".split())
LIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
TABLE = frozenset(["table"])
ITEM = BLOCK - {"div", "p", "address", "li", "dt", "dd"}
# Words of class and id names, and roles, that mark boilerplate or content.
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog".split())
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar side aside footer foot header masthead comment comments reply replies discussion disqus respond related recommended "
    "share sharing social newsletter subscribe subscription signup login cookie cookies consent gdpr popup modal overlay notice notices alert "
    "widget pagination pager tags toolbar skip hidden".split()
)
#: A block with this share of its text in links isn't content.
LINKED = 0.5
CONTENT = frozenset("article body content entry main post story text page column".split())
# First words of class names that say how a page is laid out, not what an element is.
LAYOUT = frozenset("no has with without is not hide show".split())
#: Words after which a name is boilerplate wherever they stand in it.
ALWAYS = frozenset("comment comments reply replies disqus".split())
#: What names of boilerplate are run together with.
RUN_ON = ("list", "box", "wrap", "wrapper", "area", "form", "section", "block", "container", "bar", "links", "count", "items", "thread", "holder", "panel")
#: Elements nested deeper aren't told apart from their parents.
DEPTH = 256
#: A paragraph of so many characters reads like part of an article.
READABLE = 80

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?i)(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PART = re.compile(r"[A-Za-z][a-z]*")
_COMMAS = re.compile("[,，、،]")


class Node:
    """An element: its children are nodes and strings, in page order."""

    __slots__ = ("children", "closed", "depth", "length", "links", "noise", "parent", "pruned", "score", "soft", "tag", "weight")

    def __init__(self, tag: str, parent: Node | None, weight: float = 0.0, pruned: bool = False, soft: bool = False):
        self.tag, self.parent, self.weight = tag, parent, weight
        self.pruned, self.soft = pruned, soft  # boilerplate by its own marks; by such as may err
        self.noise = pruned or (parent is not None and parent.noise)  # it or what it stands in is boilerplate
        self.depth = 0 if parent is None else parent.depth + 1
        self.closed = False
        self.children: list[Node | str] = []
        self.score = 0.0
        self.length = self.links = 0


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)} if "=" in text or "hidden" in text else {}


def _parts(word: str) -> list[str]:
    """A word of a name, and the word of boilerplate that another one is run together with."""
    for end in RUN_ON:
        if word.endswith(end) and word.removesuffix(end) in NOISE:
            return [word.removesuffix(end)]
    return [word]


def _noisy(names: str) -> bool:
    """Whether one of several class or id names is that of boilerplate: by its last word, or by another beside which none says content."""
    for name in names.split():
        words = [p for x in _NAME_PART.findall(name) for p in _parts(x.lower())]
        if not words or words[0] in LAYOUT:
            continue
        if words[-1] in NOISE or not ALWAYS.isdisjoint(words):
            return True
        if not NOISE.isdisjoint(words) and CONTENT.isdisjoint(words):
            return True
    return False


def _judge(tag: str, attributes: str) -> tuple[bool, bool, float]:
    """(boilerplate, by marks that may err, weight) of an element."""
    if tag in PRUNED:
        return True, tag in ("form", "fieldset", "label"), 0.0
    weight = {"article": 25.0, "main": 15.0}.get(tag, 0.0)
    if attributes and (a := _attributes(attributes)):
        if a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
            return True, False, 0.0
        names = f"{a.get('class', '')} {a.get('id', '')}"
        if tag not in ("article", "main", "body") and _noisy(names):
            return True, True, 0.0
        weight += 10.0 if not CONTENT.isdisjoint(x.lower() for x in _NAME_PART.findall(names)) else 0.0
    return False, False, weight


def _inside(at: Node, tag: str) -> bool:
    n: Node | None = at
    while n is not None and n.tag != tag:
        n = n.parent
    return n is not None


def parse(page: str) -> Node:
    """The page's tree, boilerplate marked, without raw-text elements and comments."""
    root = Node("html", None)
    at, pos = root, 0
    tokens = _TOKEN.scanner(page)
    while m := tokens.search():
        if m.start() > pos:
            at.children.append(page[pos : m.start()])
        pos = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if not m[1]:
            if tag in RAW:
                if not m[3].endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, pos)
                    pos = end.end() if end else len(page)
                    tokens = _TOKEN.scanner(page, pos)
                continue
            if at.tag == "head" and tag not in IN_HEAD and at.parent is not None:
                at = at.parent
            if tag in VOID:
                if tag in ("br", "hr"):
                    at.children.append("\n" if tag == "br" else Node("hr", at))
                continue
            if tag in CLOSES_P:
                at = _close_paragraph(at, tag)
            if tag in ("html", "body"):
                continue
            if at.depth >= DEPTH:
                if tag not in BLOCK:
                    continue
                at = at.parent or at
            if tag == "header" and not at.noise and _inside(at, "article"):
                pruned, soft, weight = False, False, 0.0  # an article's own heading
            elif at.tag == "header" and not at.noise and tag not in HEADINGS | {"div", "section", "a", "span", "b", "i", "em", "strong"}:
                pruned, soft, weight = True, False, 0.0
            else:
                pruned, soft, weight = _judge(tag, m[3])
            node = Node(tag, at, weight, pruned, soft)
            at.children.append(node)
            at = node
        else:
            at = _close(at, tag)
    if pos < len(page):
        at.children.append(page[pos:])
    _take_back(root)
    return root


def _take_back(root: Node) -> None:
    """Where no readable paragraph is left, unmark the pruned element that holds most of them, and what stands in it, again."""
    for _ in range(8):
        held: dict[int, list] = {}
        todo: list[tuple[Node, Node | None]] = [(root, None)]
        seen = False
        while todo and not seen:
            n, by = todo.pop()
            if n.pruned:
                # what surely is boilerplate hides all in it
                if not n.soft and (n.closed or n.tag not in ("nav", "header", "footer", "aside")):
                    continue
                by = by or n
            if n.tag == "p" or n.tag in ("article", "main"):
                size = sum(len(c) for c in n.children if isinstance(c, str)) + sum(len(x) for c in n.children if isinstance(c, Node) and c.tag not in BLOCK for x in c.children if isinstance(x, str))
                if size >= READABLE or (n.tag != "p" and by is None and size > 0):
                    if by is None:
                        seen = True
                    else:
                        held.setdefault(id(by), [0, by])[0] += size
            todo += [(c, by) for c in n.children if isinstance(c, Node)]
        if seen or not held:
            return
        max(held.values(), key=lambda x: x[0])[1].pruned = False


def _close_paragraph(at: Node, tag: str) -> Node:
    """Close what a new block element ends: an open paragraph, and a like item of the same list or table."""
    like = LIKE.get(tag, ())
    n = at
    while n.parent is not None and n.tag not in BLOCK:
        if n.noise and (n.tag in PRUNED or not like):
            return at  # a pruned button or span holds blocks
        n = n.parent
    if n.tag == "p" and n.parent is not None:
        at = n = n.parent
    if like:
        stops = TABLE if tag in ("tr", "td", "th") else ITEM
        while n.parent is not None and n.tag not in like and n.tag not in stops and n.tag not in PRUNED:
            n = n.parent
    while n.tag in like and n.parent is not None:
        at = n = n.parent
    return at


def _close(at: Node, tag: str) -> Node:
    n, inline = at, tag not in BLOCK and tag not in PRUNED
    while n.parent is not None:
        if inline and at.noise and not n.noise:
            return at  # nor does it close what stands around a pruned element
        if n.tag == tag:
            n.closed = True
            return n.parent
        if inline and n.tag in BLOCK and not n.noise:
            return at  # an inline end tag doesn't close a block
        n = n.parent
    return at


def visible(node: Node) -> list[Node | str]:
    """A node's children; in the place of a pruned one something empty that separates blocks."""
    return [Node("hr", None) if isinstance(c, Node) and c.pruned else c for c in node.children]


def _measure(node: Node, candidates: list[Node]) -> None:
    """Text and link lengths of every element, and the paragraphs' points; children first, without recursion."""
    order, todo = [], [node]
    while todo:
        n = todo.pop()
        order.append(n)
        n.children = visible(n)
        todo += [c for c in n.children if isinstance(c, Node)]
    for n in reversed(order):
        own, commas, own_text = 0, 0, 0
        for c in n.children:
            if isinstance(c, str):
                size = len(" ".join(c.split()))
                own += size
                own_text += size
                commas += len(_COMMAS.findall(c))
            else:
                own += c.length
                n.links += c.links
                if c.tag not in BLOCK:
                    own_text += c.length
                    commas += int(c.score)
        n.length = own
        if n.tag == "a":
            n.links = own
        if n.tag not in BLOCK:
            n.score = float(commas)  # handed up to the block that the text stands in
            continue
        if own_text and (n.tag in PARAGRAPH or own_text >= 25):
            share = 1.0 - (n.links / n.length if n.length else 0.0)
            points = (1.0 + commas + min(own_text / 100.0, 3.0)) * share
            holder = n.parent if n.tag in PARAGRAPH and n.parent is not None else n
            level = 0
            while holder is not None and level < 6:
                if holder.tag in BLOCK:
                    holder.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
                    level += 1
                holder = holder.parent
        candidates.append(n)


def main_nodes(root: Node) -> list[Node | str]:
    """The best container, with the siblings worth keeping, in page order."""
    candidates: list[Node] = []
    _measure(root, candidates)
    best, top = None, 0.0
    for n in reversed(candidates):
        if n.score > 0 and n.tag not in ("p", "li", "tr", "td", "tbody", "thead"):
            final = (n.score + n.weight) * (1.0 - n.links / max(1, n.length))
            if final > top:
                best, top = n, final
    if best is None:
        return [root]
    # the outermost article, or else the outermost main, that the best container lies in
    marked: dict[str, Node] = {}
    n: Node | None = best
    while n is not None:
        if n.tag in ("article", "main"):
            marked[n.tag] = n
        n = n.parent
    best = marked.get("article") or marked.get("main") or best
    in_main = best.tag == "article" and "main" in marked
    if best.parent is None:
        return [best]
    bounded = bool(marked) and not in_main  # what stands beside it isn't of the article, unless it reads so
    kept: list[Node | str] = []
    for c in best.parent.children:
        if c is best:
            kept.append(c)
        elif isinstance(c, str):
            if not bounded:
                kept.append(c)
        elif c.length:
            density = c.links / c.length
            scored = c.tag in BLOCK and c.score * (1 - density) >= max(10.0, 0.2 * top)
            prose = c.tag == "p" and c.length > 80 and density < 0.25
            heading = c.tag in ("h1", "h2") and density < 0.25
            if density < LINKED if not bounded else scored or prose or heading:
                kept.append(c)
        elif c.tag in BLOCK:
            kept.append(c)  # empty: it only separates blocks
    return kept


def blocks(nodes: list[Node | str]) -> list[str]:
    """The text of each block below ``nodes``, in page order."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        if line:
            text = " ".join(html.unescape("".join(line)).split())
            if text:
                out.append(text)
            line.clear()

    todo: list[Node | str | None] = list(reversed(nodes))
    while todo:
        n = todo.pop()
        if n is None:
            end()
        elif isinstance(n, str):
            line.append(n)
        elif n.tag in BLOCK:
            end()
            todo.append(None)
            todo += reversed(n.children)
        else:
            todo += reversed(n.children)
    end()
    return out


def main_text(page: str | None) -> str:
    return "\n".join(blocks(main_nodes(parse(page)))) if page else ""


def extract_main_text(pages: DataFrame) -> DataFrame:
    """One row per page of ``pages`` (``page_id``, ``url``, ``html``): see ``SCHEMA``."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in small(batches):
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            sizes = pa.array(list(map(len, texts)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, SCHEMA)
