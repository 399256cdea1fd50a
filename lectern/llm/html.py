"""Main-text extraction by composite text density.

Each page becomes a tree of blocks; text that stands beside blocks is a block too. Of every block the density is computed
from its subtree's characters, link characters, tags and link tags; the density sum of a block adds up the densities of
its children, and is the own density where it holds text alone. The block with the greatest sum is the core of the
article, whatever its element; the smallest density on the path from it to the body is the threshold. Of every block that
reaches it, the one with the greatest sum in it is kept whole.

Parts whose element, role or style says that they are never article text (menus, controls, scripts, what is hidden, ...) go.
A class or an id, and being a form, only weigh: parts named as comments, notices, adverts and the like, and forms, are weighed
apart, and count for nothing beside the rest unless the greatest density sum in such a part, times NAMED_WEIGHT, is more than
that of the whole rest; then the article is in that part (as where one form holds the whole page), and its name is
disregarded. The header of an article is no header of the page: it stays.

A page takes time in proportion to its length and the depth of what it closes: end tags without a beginning are told by
counts of open elements, and all named parts are weighed in one pass.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import mapped

#: Elements of HTML by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg canvas object audio video".split())
NEVER = RAW | frozenset("head nav header footer aside button select option input dialog menu datalist label legend optgroup output progress meter annotation annotation-xml".split())
#: Elements that only weigh, like a name does, and those whose header is the story's own.
WEIGHS, STORY = frozenset({"form", "fieldset"}), frozenset({"article", "main"})
BLOCK = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"br", "html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "option", "summary", "figcaption", "li", "dd", "dt"} | {"li", "dd", "dt"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end when one like them begins, and what they end at.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "tfoot": ({"tr", "td", "th", "tbody"}, {"table"})}
#: Words in class, id and role that name parts which are no article text.
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert(?:s|isement|ising)?|adsense|adbox|adslot|sponsor(?:ed|s)?|promo(?:tion|ted)?|banner|nav(?:bar|igation)?|menu|breadcrumbs?|sidebar|side-bar|aside|rail|widget|footer|header|masthead|topbar|comments?|comment-list|respond|disqus|discussion|replies|reply|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|pagination|pager|toolbar|search|copyright|legal|disclaimer|skip-link|print-only|hidden|sr-only)(?:$|[\s_-])",
    re.I,
)
#: What the density sum of a part named by NAMED counts for.
NAMED_WEIGHT = 0.05
#: Those of them that name the head of a story where they stand in one.
STORY_HEAD = frozenset({"header", "masthead"})
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())

_MARKUP = re.compile(r"<!--(?:.*?-->|.*)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")


#: What a beginning element ends: the tags, and where the search for them stops.
ENDING = [({"p"}, {"div", "article", "section", "main", "td", "li", "blockquote", "body", "button"}), *SIBLINGS.values()]
_ENDS = frozenset().union(*(tags | stop for tags, stop in ENDING))
_SIBLING_AT = {tag: i for i, tag in enumerate(SIBLINGS, 1)}


class Node:
    __slots__ = ("tag", "parent", "parts", "out", "chars", "links", "tags", "link_tags", "density", "total", "keep", "block", "best", "named", "skip", "linked", "ends", "story")

    def __init__(self, tag: str, parent: Node | None, out: bool = False, named: bool = False):
        #: For each of ENDING the outermost open element that it would end from here, or None; and whether this is in a story.
        self.ends: tuple[Node | None, ...] = parent.ends if parent else (None,) * len(ENDING)
        if tag in _ENDS:
            self.ends = tuple(None if tag in stop else (x or self) if tag in tags else x for (tags, stop), x in zip(ENDING, self.ends))
        self.story = tag in STORY or parent is not None and parent.story
        self.tag, self.parent, self.out, self.named, self.skip = tag, parent, out, named, False
        self.parts: list[Node | str] = []
        self.chars = self.links = self.tags = self.link_tags = 0
        self.density = self.total = 0.0
        self.keep = self.linked = False
        #: Whether the node is a block or holds one, and the block with the greatest density sum in it.
        self.block = False
        self.best: Node | None = None


def _kind(tag: str, attrs: str, story: bool = False) -> tuple[bool, bool]:
    """Whether an element is never article text, and whether its name says so. ``story``: it stands in an article."""
    if tag in NEVER and not (story and tag == "header"):
        return True, False
    named = tag in WEIGHS
    if attrs and not attrs.isspace():
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
            if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
                named = named or any(not (story and w.strip(" \t\n\r\f\v_-").lower() in STORY_HEAD) for w in NAMED.findall(value))
            if name == "role" and value.strip().lower() in ROLES:
                return True, False
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True, False
    return False, named


def tree(page: str) -> Node:
    """Elements and text of a page; end tags may be missing and the page may break off anywhere."""
    root = at = Node("#root", None)
    pos, n = 0, len(page)
    opened: Counter[str] = Counter()

    def up_to(node: Node) -> Node:
        """``node``, which is open, with all that is open in it ended."""
        x = at
        while x is not node:
            opened[x.tag] -= 1
            x = x.parent
        return node

    while pos < n:
        lt = page.find("<", pos)
        if lt < 0:
            at.parts.append(page[pos:])
            break
        if lt > pos:
            at.parts.append(page[pos:lt])
        m = _MARKUP.match(page, lt) or _LOOSE.match(page, lt)
        if not m:
            at.parts.append("<")
            pos = lt + 1
            continue
        pos = m.end()
        if m.re is _MARKUP and m[3] is None:
            if m[1]:
                at.parts.append(html.escape(m[1], quote=False))
            continue
        end, tag, attrs = (m[2], m[3].lower(), m[4]) if m.re is _MARKUP else (m[1], m[2].lower(), m[3])
        if end:
            if opened[tag] > 0:
                up = at
                while up.tag != tag:
                    up = up.parent
                at = up_to(up.parent)
            elif tag in ("p", "br"):
                at.parts.append(Node(tag, at))
            continue
        if tag in ("html", "body"):
            # A second one, or one inside an unfinished head, only goes on with the page.
            at = up_to(root) if tag == "html" or at.tag == "head" else at
        if tag in CLOSES_P and at.ends[0]:
            at = up_to(at.ends[0].parent)
        if tag in SIBLINGS and at.ends[_SIBLING_AT[tag]]:
            at = up_to(at.ends[_SIBLING_AT[tag]].parent)
        if at.tag in HEADINGS and tag in HEADINGS:
            at = up_to(at.parent)
        node = Node(tag, at, *_kind(tag, attrs, at.story))
        at.parts.append(node)
        if tag in VOID or attrs.endswith("/") and tag in RAW:
            continue
        if tag in RAW:
            shut = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)[^>]*>?", re.I).search(page, pos)
            pos = shut.end() if shut else n
            continue
        at = node
        opened[tag] += 1
    return root


def _order(root: Node) -> list[Node]:
    """Nodes, each before its children."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [x for x in node.parts if isinstance(x, Node)]
    return out


def _boxed(root: Node) -> None:
    """Mark blocks, and wrap what stands between the blocks of a node into blocks of their own."""
    for node in reversed(_order(root)):
        node.block = node.block or node.tag in BLOCK and node.tag != "br" or node.parent is None
        if node.block and node.parent:
            node.parent.block = True
        if not any(isinstance(x, Node) and x.block for x in node.parts):
            continue
        parts, run = [], None
        for x in node.parts:
            if isinstance(x, Node) and x.block:
                run = None
                parts.append(x)
                continue
            if run is None:
                run = Node("#run", node)
                run.block = True
                parts.append(run)
            run.parts.append(x)
            if isinstance(x, Node):
                x.parent = run
        node.parts = parts


def weigh(root: Node) -> list[Node]:
    """Set density and density sum of all nodes under ``root``. A named part is weighed by itself: it counts for nothing in
    what it stands in, nor do named parts in it. Nodes that are out count for nothing. Blocks must be marked (``_boxed``)."""
    nodes = _order(root)
    for node in nodes:
        up = node.parent
        node.skip = node.out or up is not None and up.skip
        node.linked = node.tag == "a" or up is not None and up.linked and not node.named
        node.chars = node.links = node.tags = node.link_tags = 0
        node.density = node.total = 0.0
        node.best = None
    for node in reversed(nodes):
        if node.skip:
            continue
        own = sum(len(_SPACE.sub(" ", html.unescape(t)).strip()) for t in node.parts if isinstance(t, str))
        node.chars += own
        if node.linked:
            node.links += own
        if node.parent and not node.named:
            up = node.parent
            up.chars += node.chars
            up.links += node.links
            up.tags += node.tags + (node.tag not in VOID and node.tag not in ("#run", "b", "i", "em", "strong", "span", "u", "sub", "sup", "small", "mark", "code", "abbr", "cite", "q", "font"))
            up.link_tags += node.link_tags + (node.tag == "a")
    body = next((x for x in nodes if x.tag == "body"), root)
    ratio = body.links / max(1, body.chars)
    for node in reversed(nodes):
        if node.skip:
            continue
        c, lc, t, lt = node.chars, node.links, max(1, node.tags), max(1, node.link_tags)
        if c:
            base = math.log(c / max(1, c - lc) * lc + ratio * c + math.e)
            node.density = max(0.0, c / t * math.log(c / max(1, lc) * t / lt + 1e-9, max(base, 1 + 1e-9))) if c > lc else 0.0
        if not node.block:
            continue
        inside = [x for x in node.parts if isinstance(x, Node) and x.block and not (x.skip or x.named) and x.chars]
        node.total = sum(x.density for x in inside) if inside else node.density
        node.best = max([*(x.best for x in inside), node], key=lambda x: x.total)
    return nodes


def weighed(root: Node) -> list[Node]:
    """``weigh``, after the name of the part that has the article, if a named one does, is disregarded; the other named parts
    are to be skipped then."""
    _boxed(root)
    for x in _order(root):
        x.block = x.block or x.named
    nodes = weigh(root)
    parts = [x for x in nodes if x.named and not x.skip]
    most, chosen = root.best.total if root.best.chars > root.best.links else 0.0, None
    for part in parts:
        if part.best.chars > part.best.links and NAMED_WEIGHT * part.best.total > most:
            most, chosen = NAMED_WEIGHT * part.best.total, part
    if chosen:
        for x in _upward(chosen):
            x.named = False
        nodes = weigh(root)
    for x in nodes:
        x.skip = x.skip or x.named or x.parent is not None and x.parent.skip
    return nodes


def _upward(node: Node) -> Iterator[Node]:
    while node:
        yield node
        node = node.parent


def _mark(nodes: list[Node]) -> None:
    """Keep the block of the greatest density sum, and that of each block as dense as the least dense one on its path to the body."""
    core = nodes[0].best
    if not core.chars > core.links:
        return
    body = next((x for x in nodes if x.tag == "body"), nodes[0])
    least, up = core.density, core
    while up.parent and up is not body:
        up = up.parent
        if up.chars and up.tag not in ("#root", "html"):
            least = min(least, up.density)
    core.keep = True
    for x in nodes:
        if x.block and not x.skip and x.density >= least and x.density > 0 and x.tag not in ("#root", "html", "body"):
            x.best.keep = True


def main_text(page: str) -> str:
    """The article text of a page: blocks in page order, white space inside each made one space, joined by a space."""
    root = tree(page)
    _mark(weighed(root))
    blocks: list[list[str]] = [[]]
    todo: list[tuple] = [(root, False)]
    while todo:
        node, kept = todo.pop()
        if isinstance(node, str):
            if node == "\0":
                blocks.append([])
            elif kept:
                blocks[-1].append(node)
            continue
        if node.skip:
            if node.tag in BLOCK:
                blocks.append([])
            continue
        kept = kept or node.keep
        edge = node.tag in BLOCK or node.tag == "#run"
        if edge:
            blocks.append([])
            todo.append(("\0", False))
        todo += [(x, kept) for x in reversed(node.parts) if not (isinstance(x, str) and x == "\0")]
    texts = (_SPACE.sub(" ", html.unescape("".join(b))).strip() for b in blocks)
    return " ".join(t for t in texts if t)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """The main text of every whole page.

    One row per input row: ``id_col``, the columns in ``keep``, text (empty if the page has none, or is null) and n_chars
    (its code points). Null and repeated ids keep a row each, and an empty table gives no rows; other columns are left out.
    """
    fields = {c: pages.schema[c].dataType.simpleString() for c in (id_col, *keep)}
    out = ", ".join([*(f"c{i} {t}" for i, t in enumerate(fields.values())), "text string, n_chars long"])
    kept = [f"c{i}" for i in range(len(fields))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for at in range(0, x.num_rows, 256):
                part = x.slice(at, 256)
                texts = [main_text(t.as_py() or "") for t in part.column(len(kept))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*kept, "text", "n_chars"])

    source = pages.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(fields)), F.col(html_col).alias("page"))
    found = mapped(source, run, out)
    return found.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(fields)), "text", "n_chars")
