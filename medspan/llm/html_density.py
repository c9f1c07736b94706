"""Main text of web pages by composite text density.

A tolerant tokenizer builds each page's element tree (optional end tags are
inferred). Every node gets its composite density: characters per tag, adjusted
by the characters inside and outside links,

    C/T * log_b((C/LC) * (T/LT)),  b = ln(C/nonLC * LC + body LC/body C * C + e)

and the sum of its children's densities. The node with the largest density sum
is the page's core; the threshold is the least density on the path from the core
to the body. From the body down, the core's ancestors whose other children reach
that threshold too are widened to. If the core stands in an article or main
element, or such elements hold a third of it, they bound the text: of the
outermost ones all are kept whole in which something reaches the threshold.
Elements that are never content (navigation, headers, footers, asides, forms,
scripts, hidden parts, adverts, notices and reader comments, by tag, role or the
words of class and id) take no part. Names and forms don't exclude an element
that holds most of the text outside links, nor names as ``no-sidebar``.

Text of a block has its white space collapsed; blocks are joined by one space.

Defined results: null or empty html, or a page without text, gives the empty
text; repeated rows give the same result; an empty table gives no rows. Deep
nesting and unclosed elements take no recursion.
"""

from __future__ import annotations

import html as _html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
NEVER = frozenset("script style noscript template iframe object svg canvas annotation annotation-xml head title nav footer aside button select textarea input dialog menu map audio video noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br".split())
#: Elements that an opening tag closes, as far as the next element of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
_CLOSE_P = BLOCK - {"br", "body", "html"} - {"dd", "dt", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "summary", "figcaption"} | {"li", "dd", "dt"}
_SCOPE = frozenset("html body table td th caption button object".split())
_WORDS = re.compile(
    r"(?:^|[\s_-])(ads?|ad(?:box|slot|unit|block|wrap|container)\w*|advert\w*|adsense|banner\w*|sponsor\w*|promo\w*|\w{0,6}nav|nav(?:bar|igation|links?|menu)|\w{0,6}menu\w*|breadcrumbs?|side-?bars?|\w{0,6}footer|masthead|cookie\w*|consent|gdpr|notices?|popups?|modal|overlay|subscribe|newsletter|signup|login|share|sharing|social|related|recommend\w*|comment\w*|disqus|respond|reply|replies|discussion|widgets?|toolbar|pagination|pager|skip|copyright|legal|disclaimer|alert)(?=$|[\s_-])", re.I
)
#: Parts of a name that say what an element goes without or holds, not what it is.
_MODIFIED = re.compile(r"(?:^|[_-])(?:no|non|not|with|without|has|have|hide)[_-]", re.I)
_COMMENT = re.compile(r"comment\w*|disqus|respond|reply|replies", re.I)
#: Words that name content as well; within an article or main they, and names with other parts, only tell lists of links.
_DOUBTFUL = re.compile(r"notices?|related|recommend\w*|discussion|copyright|legal|disclaimer|alert|social|skip", re.I)
_ADVERT = re.compile(r"ads?|advert\w*|adsense|sponsor\w*", re.I)
_HEADER = re.compile(r"(?:^|[\s_-])(?:header|page-header|site-header|topbar|top-bar)(?:$|[\s_-])", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())


#: Kinds of elements: content, never content, and those that only their name or a form excludes.
CONTENT, HARD, NAMED, DOUBTFUL, COMMENTS, ADVERT = range(6)


class Node:
    __slots__ = ("tag", "parent", "children", "never", "kind", "plain", "linked", "marked", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, kind: int = CONTENT):
        self.tag, self.parent, self.children, self.never, self.kind = tag, parent, [], kind != CONTENT, kind
        self.plain = self.linked = self.marked = 0
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _kind(tag: str, attributes: str, inside: bool) -> int:
    """Kind of an element, by its tag, role, style and names."""
    if tag in NEVER or tag == "header" and not inside:
        return HARD
    if not attributes.strip(" /\t\n\r"):
        return NAMED if tag == "form" else CONTENT
    got = {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in _ATTRIBUTE.finditer(attributes)}
    role = got.get("role", "").lower()
    if "hidden" in got or got.get("aria-hidden", "").lower() == "true" or role in _ROLES and (tag, role) != ("form", "form"):
        return HARD
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", got.get("style", ""), re.I):
        return HARD
    if tag in ("html", "body", "article", "main"):
        return HARD if tag == "article" and re.search(r"(?:^|[\s_-])comments?(?:$|[\s_-])", f"{got.get('class', '')} {got.get('id', '')}", re.I) else CONTENT
    names = [n for n in f"{got.get('class', '')} {got.get('id', '')}".split() if not _MODIFIED.search(n)]
    words = [m[1] for n in names for m in _WORDS.finditer(n)]
    whole = any(all(map(_WORDS.fullmatch, re.split("[-_]+", n.strip("-_")))) for n in names)  # else a name holds other words as well
    if tag != "form" and any(map(_ADVERT.fullmatch, names)):
        return ADVERT
    if any(map(_COMMENT.fullmatch, words)):
        return COMMENTS
    if tag == "form" or not inside and any(map(_HEADER.search, names)):
        return NAMED
    return CONTENT if not words else DOUBTFUL if not whole or all(map(_DOUBTFUL.fullmatch, words)) else NAMED


#: Groups of CLOSES, and the scope of paragraphs, by tag: (number, whether the tag bounds the group).
_GROUPS: dict[str, list[tuple[int, bool]]] = {}
_GROUP_OF: dict[str, int] = {}
for _tag, (_what, _stop) in [*CLOSES.items(), ("p", ({"p"}, _SCOPE))]:
    _number = _GROUP_OF.setdefault(f"{sorted(_what)} {sorted(_stop)}", len(_GROUP_OF))
    _GROUP_OF[_tag] = _number
    for _t in (*_what, *_stop):
        if (_number, _t in _stop) not in _GROUPS.setdefault(_t, []):
            _GROUPS[_t].append((_number, _t in _stop))
_BOUNDS = frozenset({"table", "article", "main", "body"})


class _Open:
    """The open elements. What an end tag or an optional end closes is found without walking up."""

    def __init__(self, root: Node):
        self.path = [root]
        self.at: dict[str, list[int]] = {}
        self.bounds: list[int] = []
        self.groups: list[list[list[int]]] = [[[]] for _ in range(len(_GROUP_OF))]

    def push(self, node: Node) -> None:
        place, tag = len(self.path), node.tag
        self.path.append(node)
        self.at.setdefault(tag, []).append(place)
        if tag in _BOUNDS:
            self.bounds.append(place)
        for g, stop in _GROUPS.get(tag, ()):
            if stop:
                self.groups[g].append([])
            else:
                self.groups[g][-1].append(place)

    def cut(self, place: int) -> None:
        """Closes all from a place on."""
        while len(self.path) > place:
            tag = self.path.pop().tag
            self.at[tag].pop()
            if tag in _BOUNDS:
                self.bounds.pop()
            for g, stop in _GROUPS.get(tag, ()):
                (self.groups[g] if stop else self.groups[g][-1]).pop()

    def within(self, *tags: str) -> bool:
        return any(self.at.get(t) for t in tags)

    def close(self, tag: str) -> None:
        """An end tag; one of an inline element doesn't reach past a table, article, main or body."""
        places = self.at.get(tag)
        if places and (tag in BLOCK or not self.bounds or self.bounds[-1] <= places[-1]):
            self.cut(places[-1])


def parse(page: str) -> Node:
    """The element tree; children are nodes and strings (raw, with character references)."""
    root = Node("html", None)
    body, open_ = None, _Open(root)
    path = open_.path
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            path[-1].children.append(page[at:])
            break
        if m.start() > at:
            path[-1].children.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA["):
                path[-1].children.append(_html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = name.lower()
        if m[1]:
            if tag == "br" or tag == "p" and not open_.groups[_GROUP_OF["p"]][-1]:
                path[-1].children.append(Node(tag, path[-1]))
            else:
                open_.close(tag)
            continue
        if tag in ("html", "body"):
            if tag == "body" and body is None:
                body = Node("body", root)
                root.children.append(body)
                open_.cut(1)
                open_.push(body)
            continue
        if path[-1].tag == "head" and tag not in ("meta", "link", "base", "title", "style", "script", "noscript", "template"):
            open_.cut(len(path) - 1)
        if tag in _CLOSE_P and (p := open_.groups[_GROUP_OF["p"]][-1]):
            open_.cut(p[-1])
        if tag in CLOSES and (same := open_.groups[_GROUP_OF[tag]][-1]):
            open_.cut(same[0])
        node = Node(tag, path[-1], _kind(tag, m[3], open_.within("article", "main")))
        path[-1].children.append(node)
        if tag in VOID or m[3].endswith("/") and tag in ("svg", "path"):
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            stop = close.start() if close else end
            node.children.append(page[at:stop])
            at = page.find(">", stop) + 1 if close else end
            if at == 0:
                at = end
            continue
        open_.push(node)
    return root


def _order(root: Node) -> list[Node]:
    """Nodes that can be content, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if not node.never:
            out.append(node)
            stack.extend(x for x in reversed(node.children) if not isinstance(x, str))
    return out


def measure(root: Node) -> list[Node]:
    """Fills in counts, densities and density sums; returns the nodes, parents first."""
    nodes = _order(root)
    for node in reversed(nodes):
        for x in node.children:
            if isinstance(x, str):
                node.chars += len(x) - x.count(" ") if not x.isspace() else 0
            elif not x.never:
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags + (x.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    top = nodes[0] if nodes else root
    share = top.link_chars / max(1, top.chars)
    for node in nodes:
        c, t, lc, lt = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
        if c:
            base = math.log(c / max(1, c - node.link_chars) * node.link_chars + share * c + math.e)
            node.density = c / t * math.log(c / lc * t / lt + 1e-9) / max(1e-9, math.log(base + 1e-9)) if base > 1.0001 and c / lc * t / lt > 1 else c / t * (1e-3 if node.link_chars >= c else 1.0)
    for node in nodes:
        node.total = sum(x.density for x in node.children if not isinstance(x, str) and not x.never)
    return nodes


def core(root: Node) -> list[Node]:
    """The subtrees that hold the main text, in page order."""
    nodes = measure(root)
    nodes = [n for n in nodes if n.chars]
    if not nodes:
        return []
    best = max(nodes, key=lambda n: (n.total, n.density))
    path, node = [], best
    while node is not None:
        path.append(node)
        node = node.parent
    threshold = min(n.density for n in path)
    marks: dict[Node, Node] = {}  # by node within an article or main, the outermost one
    for n in nodes:
        if n.parent in marks or n.tag in ("article", "main"):
            marks[n] = marks.get(n.parent, n)
    outermost = [n for n in marks if marks[n] is n]
    inner = {best}  # the core and what it holds
    for n in nodes:
        if n.parent in inner:
            inner.add(n)
    above = sum(m.chars for m in outermost if m in inner)
    if best in marks or above * 3 >= best.chars:  # they bound the core, unless it lies elsewhere or they hold little of it
        dense = {m for n, m in marks.items() if n.density >= threshold and n.link_chars * 3 < n.chars}
        own = marks.get(best)
        if dense or own:
            return [m for m in outermost if m in dense or m is own]
    chosen = best
    for node in path[1:]:
        if node.tag == "html":
            break
        others = [x for x in node.children if not isinstance(x, str) and not x.never and x is not chosen and x.chars]
        dense = sum(x.chars for x in others if x.density >= threshold and x.link_chars * 3 < x.chars)
        loose = sum(len(x.strip()) for x in node.children if isinstance(x, str))
        if dense or loose:
            chosen = node
    return [chosen]


def text_of(node: Node) -> str:
    """Blocks of a subtree in page order."""
    out: list[str] = []
    parts: list[str] = []
    stack: list[Node | str | None] = [node]

    def flush():
        block = _SPACE.sub(" ", _html.unescape("".join(parts))).strip()
        if block:
            out.append(block)
        parts.clear()

    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            parts.append(x)
        elif not x.never:
            if x.tag in BLOCK:
                flush()
                stack.append(None)
            stack.extend(reversed(x.children))
    flush()
    return " ".join(out)


def main_text(page: str | None) -> str:
    """Main text of one page."""
    if not page:
        return ""
    root = parse(page)
    _take_back(root)
    nodes = core(root)
    if not nodes and _soften(root):
        nodes = core(root)
    return " ".join(filter(None, map(text_of, nodes)))


def _take_back(root: Node) -> None:
    """Takes elements back in that only a name or a form excludes, if they hold most of the
    text outside links: of the page, or if article and main elements hold a third of that,
    of the one around them; around such elements, if they hold most of these. Comments, and
    what stands beside a smaller article, need nine tenths; what is named an advert as a whole
    stays out. Doubtful names within an article or main only exclude lists of links."""
    order: list[tuple[Node, Node | None]] = []
    stack: list[tuple[Node, Node | None]] = [(root, None)]
    some = False
    while stack:
        node, mark = stack.pop()
        if node.kind != HARD:
            mark = node if mark is None and node.tag in ("article", "main") else mark
            some |= node.kind != CONTENT
            order.append((node, mark))
            stack.extend((x, mark) for x in node.children if not isinstance(x, str))
    if not some:
        return
    for node, _ in reversed(order):
        for x in node.children:
            if isinstance(x, str):
                node.plain += len(x) - x.count(" ") if not x.isspace() else 0
            elif x.kind != HARD:
                node.plain, node.linked, node.marked = node.plain + x.plain, node.linked + x.linked, node.marked + x.marked
        if node.tag == "a":
            node.plain, node.linked = 0, node.linked + node.plain
        if node.tag in ("article", "main"):
            node.marked = node.plain
        elif node.kind == COMMENTS:
            node.marked = 0
    bound = 0 < root.plain <= root.marked * 3
    for node, mark in order:
        if node.kind != CONTENT:
            part, whole = (node.plain, mark.plain) if bound and mark else (node.marked, root.marked) if bound else (node.plain, root.plain)
            strict = node.kind == COMMENTS or not bound and node.marked < root.marked and mark is None
            most = part * 10 > whole * 9 if strict else part * 2 > whole
            node.never = node.kind == ADVERT or not (most or node.kind == DOUBTFUL and mark and node.linked * 2 < node.plain)


def _soften(root: Node) -> bool:
    """Takes elements back in that only their names exclude; whether there were any."""
    stack, any_ = [root], False
    while stack:
        node = stack.pop()
        if node.kind != HARD and node.never:
            node.never, any_ = False, True
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        stack.extend(x for x in node.children if not isinstance(x, str))
    return any_


def extract_text(pages: DataFrame, html: str = "html", keep: tuple = ("page_id", "url")) -> DataFrame:
    """The columns keep, text and n_chars (code points) of each page."""
    rows = pages.select(F.col(html).alias("__html"), *[F.col(c) for c in keep])
    fields = [f.simpleString().split(":", 1) for f in pages.select(*keep).schema]

    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keep, "text", "n_chars"])

    return rows.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in fields) + ", text string, n_chars long")
