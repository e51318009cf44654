"""Main text of web pages by wrapper induction.

The pages of a host share a template. A few pages of each host (``SEEDS``, those with the least hashes of ids and html) are merged
into one reference tree by simple tree matching: nodes that match are one node, the rest is inserted (partial tree alignment).
Every page of the host is then aligned with the reference by simple tree matching, which names a slot for each text block. Blocks
outside the reference (parts that its pages don't show, other layouts, longer articles) get a slot as well: the nearest
matched element's and the path of names from there. Over *all* pages of the host it is counted on how many a text fills a slot.
Outside the article's own element, a text that is constant in its slot, or one of a few that fill most of it, is template.
Within an ``article`` or ``main`` only what stands on nearly all of the host's pages is. All other texts are content.

What the markup itself says comes in two grades. Elements that are never text (scripts, nav, footer, form, hidden parts, roles) are
left out. Class names and ids are read by their head word ("legal-notice-story" is a story): names of adverts, menus, comments and
the like (``_FIRM``) are left out, names that may also stand on prose (``_VAGUE``) are a weight only: running text below them stays,
if the host has enough pages for the slots to tell whether it varies, or if it is a paragraph within the article. Within the article
names of widgets and the like (``_LOOSE``) are vague, too, and a name that only begins with such a word ("menu-review") says nothing.

Tree matching works on shapes: trees of equal names are one shape, each pair of shapes is compared once, bottom up and without
recursion, so neither depth nor breadth of the markup is limited.

Defined results: null and empty html give the empty text; a page of which nothing but template is left, too; broken markup is
read as far as it goes; pages of any size are read whole; a page whose host is missing is aligned with the other such pages;
repeated pages count once in a slot's statistics and each give a row; null and repeated page ids do no harm; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.tables import arrow_map, parquet, small_batches, stage
from quern.llm.url_filter import split_url

SEEDS = 4
#: A text in a slot is template if it is the only one (from FEW_PAGES different pages on) or stands on more than CONSTANT of the
#: slot's pages (itself on MIN_PAGES at least), or if it is one of those on at least SHARE of the slot's pages (and on MIN_PAGES)
#: that together are more than CONSTANT of the texts in the slot. Within the article it is template if it stands in its slot on
#: FEW_PAGES and EVERYWHERE of the host's different pages. All but the least counts are shares, which don't change when a host grows.
CONSTANT, SHARE, EVERYWHERE, FEW_PAGES, MIN_PAGES = 0.5, 0.1, 0.9, 3, 6
#: Words of a block that make it running text below a vague name: in a paragraph of the article, elsewhere.
PARAGRAPH_WORDS, PROSE_WORDS = 8, 25
#: Reference trees are broadcast up to this many bytes, else joined.
BROADCAST_BYTES = 32 << 20
#: Tables of template texts are broadcast up to so many texts, and so many a host; else pages and texts are joined block by block.
BROADCAST_TEXTS, HOST_TEXTS = 1_000_000, 1_000
#: Lists of siblings whose sizes have a larger product are aligned row by row as arrays: the same table, made faster.
ARRAYS = 4_000
#: Gains that such an alignment keeps at once, and shapes and pairs that a worker keeps between pages.
GAINS, KEPT = 4_000_000, 500_000

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp noembed noframes".split())
_DROP = frozenset("script style noscript template head title nav footer aside form button select option textarea input label iframe object embed svg canvas audio video dialog menu map annotation annotation-xml".split())
_UNSEEN = frozenset("script style template annotation annotation-xml".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img ruby rt rp math mi mn mo ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup mover munder munderover mmultiscripts mtable mtr mtd mstyle mpadded mphantom menclose semantics".split())
_SELF_CLOSE = {"p": frozenset("p address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())}
_CLOSES_SAME = frozenset("li dt dd tr td th option".split())
_WORD = re.compile(r"[A-Z]*[a-z]+|[A-Z]+")
_FIRM = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors nav navbar navigation menu menus submenu breadcrumb breadcrumbs"
    " sidebar sidebars footer masthead topbar toolbar cookie cookies consent gdpr newsletter signup login signin comment comments commentlist respond reply"
    " replies disqus share sharing social pagination pager paging widget widgets copyright searchbox taboola outbrain adsbygoogle adbox adslot adunit".split()
)
_VAGUE = frozenset(
    "banner banners promo promos promoted aside notice notices popup popups modal overlay subscribe subscription related recommended recommendations legal disclaimer"
    " search skip dialog alert alerts paywall announcement feedback header".split()
)
#: Words that say nothing about what an element holds, so that the word before them counts.
_PLAIN = frozenset(
    "item items link links wrapper wrap container box list body area inner outer slot block section group top bottom left right main form button buttons bar panel unit"
    " content text icon icons row col column holder module zone region head first last large small wide fixed sticky".split()
)
#: Endings of joined names, as in mainmenu.
_ENDINGS = ("menu", "navbar", "sidebar", "footer", "comments", "advert", "newsletter")
_TITLED = frozenset("article entry post story title".split())
_PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote li dd dt td pre figcaption".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
# a quote that is not closed before a space, / or > is a character like any other
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]+|\"[^\"]*\"(?=[\s/>]|\Z)|'[^']*'(?=[\s/>]|\Z)|[\"'])*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(class|id|role|hidden|style|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?(?=[\s/]|\Z)", re.I)
_SPACE = re.compile(r"\s+")


class Node:
    """An element: ``tag``, ``name`` (tag with its class), children (Node or str), whether its markup says template (``boiler``) or
    may say so (``vague``, a grade), its slot, its shape, the child elements that matter for alignment (``frame``), and whether it
    is or holds more than markup within a line (``holds``)."""

    __slots__ = ("tag", "name", "kids", "boiler", "vague", "slot", "shape", "frame", "holds")

    def __init__(self, tag: str, name: str, boiler: bool, vague: int = 0):
        self.tag, self.name, self.boiler, self.vague = tag, name, boiler, vague
        self.kids: list = []
        self.frame: list = []
        self.holds = True
        self.slot = self.shape = -1


#: Grades of names.
LEAD, PERHAPS, LOOSE, FIRM = 1, 2, 3, 4
#: Names of _FIRM that parts of an article have as well.
_LOOSE = frozenset("widget widgets share sharing social copyright".split())


def grade(value: str) -> int:
    """What a class attribute or id says of the element: 2 template, 1 perhaps, 0 nothing."""
    return {FIRM: 2, LOOSE: 2, PERHAPS: 1, LEAD: 1}.get(fine_grade(value), 0)


def fine_grade(value: str) -> int:
    """What a class attribute or id says of the element: FIRM template, LOOSE template outside the article and perhaps within, PERHAPS,
    LEAD perhaps, but nothing within the article (its first words say it), 0 nothing."""
    best, titled = 0, False
    for token in value.split():
        words = [x.lower() for x in _WORD.findall(token)]
        if not words:
            continue
        k = len(words)
        while k > 1 and words[k - 1] in _PLAIN:
            k -= 1
        head, before = words[k - 1], words[: k - 1]
        if head in _FIRM or head.endswith(_ENDINGS):
            best = max(best, LOOSE if head in _LOOSE else FIRM)
        elif head in _TITLED and not any(x in _VAGUE and x in ("related", "recommended", "promoted") for x in before):
            titled = True
        elif head == "header" and not _TITLED.isdisjoint(before):
            titled = True
        elif head in _VAGUE or any(x in ("related", "recommended", "promoted") for x in before):
            best = max(best, PERHAPS)
        elif any(x in _FIRM for x in before):
            best = max(best, LEAD)
    return 0 if best in (LEAD, PERHAPS) and titled else best


def _quoted(value: str) -> bool:
    """Whether a class names a quotation, as of pull quotes set in an aside."""
    return any(w in ("quote", "pullquote", "blockquote") for token in value.split() for w in (x.lower() for x in _WORD.findall(token)))


def _marks(tag: str, attrs: str) -> tuple[str, bool, int]:
    """The node's name for alignment, and whether its tag or attributes mark it as template, surely or perhaps."""
    quote = tag == "aside" and "quote" in attrs.lower() and any(m[1].lower() == "class" and _quoted(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs))
    if tag in _DROP and not quote:
        return tag, True, 0
    if not attrs or "=" not in attrs and "hidden" not in attrs.lower():
        return tag, False, 0
    name, bad, said = tag, False, 0
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        low = value.lower()
        if key in ("class", "id"):
            if key == "class":
                name = f"{tag}.{low}"
            if tag not in ("html", "body", "main"):
                said = max(said, fine_grade(value))
        elif key == "role":
            bad |= low in _ROLES
        elif key == "hidden":
            bad = True
        elif key == "aria-hidden":
            bad |= low == "true"
        elif key == "style":
            bad |= any(x in low.replace(" ", "") for x in ("display:none", "visibility:hidden"))
    return name, bad or said == FIRM, 0 if said == FIRM else said


def parse(source: str) -> Node:
    """A tree of the elements; unclosed, misnested and cut markup is read as browsers mostly do."""
    root = Node("#root", "#root", False)
    stack, at, n = [root], 0, len(source)
    opened: Counter = Counter()

    def close(k: int) -> None:
        opened.subtract(x.tag for x in stack[k:])
        del stack[k:]

    while at < n:
        m = _TOKEN.search(source, at)
        if m is None:
            stack[-1].kids.append(source[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].kids.append(html.escape(m[0][9:-3]))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not opened["p"]:
                stack[-1].kids.append(Node("br", "br", False))
            for k in range(len(stack) - 1 if opened[tag] > 0 else 0, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag in _INLINE and stack[k].tag not in _INLINE:
                    break
            continue
        for inner, by in _SELF_CLOSE.items():
            if tag in by and opened[inner] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == inner:
                        close(k)
                        break
                    if stack[k].tag not in _INLINE:
                        break
        if tag in _CLOSES_SAME:
            same = ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)
            for k in range(len(stack) - 1 if any(opened[x] > 0 for x in same) else 0, 0, -1):
                if stack[k].tag in same:
                    close(k)
                    break
                if stack[k].tag in ("ul", "ol", "table", "dl", "select", "tr" if tag in ("td", "th") else "table"):
                    break
        attrs = m[3]
        node = Node(tag, *_marks(tag, attrs))
        stack[-1].kids.append(node)
        if tag in _VOID or (attrs.endswith("/") and tag not in _INLINE and tag not in ("div", "p")):
            continue
        if tag in _RAW:
            low = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            at = low.end() if low else n
            continue
        stack.append(node)
        opened[tag] += 1
    return root


def _elements(node: Node) -> list[Node]:
    return [k for k in node.kids if k.__class__ is Node]


class Matcher:
    """Simple tree matching on shapes: trees of equal names, marks and children are one shape."""

    def __init__(self):
        self.ids: dict[tuple, int] = {}
        self.name: list[str] = []
        self.kids: list[tuple] = []
        self.size: list[int] = []
        self.memo: dict[tuple[int, int], int] = {}

    def full(self) -> bool:
        return len(self.ids) + len(self.memo) > KEPT

    def shape(self, root: Node) -> int:
        """Give every node below ``root`` its shape, children first."""
        order, todo = [], [root]
        while todo:
            node = todo.pop()
            order.append(node)
            if not node.boiler:
                todo += _elements(node)
        for node in reversed(order):
            # in a paragraph, markup within a line is no structure: paragraphs that differ only in it are one shape
            inner = [] if node.boiler else _elements(node)
            node.holds = node.boiler or node.tag not in _INLINE or any(x.holds for x in inner)
            node.frame = [x for x in inner if x.holds] if node.tag in _PARAGRAPHS else inner
            key = (node.name, node.boiler, tuple(x.shape for x in node.frame))
            got = self.ids.get(key)
            if got is None:
                got = self.ids[key] = len(self.name)
                self.name.append(node.name)
                self.kids.append(key[2])
                self.size.append(1 + sum(self.size[x] for x in key[2]))
            node.shape = got
        return root.shape

    def gain(self, x: int, y: int) -> int | None:
        """Pairs in the greatest match of two shapes; None if that is still to be counted."""
        if self.name[x] != self.name[y]:
            return 0
        if x == y:
            return self.size[x]
        if not self.kids[x] or not self.kids[y]:
            return 1
        return self.memo.get((x, y))

    def score(self, x: int, y: int) -> int:
        """``gain``, after counting what it needs from the bottom up."""
        todo = [self._work(x, y)]
        while todo:
            a, b, rest = todo[-1]
            if self.gain(a, b) is not None:
                todo.pop()
                continue
            # one row of pairs at a time, so that what waits is short
            open_ = next((row for row in rest if row), None)
            if open_:
                todo += [self._work(k, m) for k, m in open_]
                continue
            todo.pop()
            self.memo[a, b] = 1 + self.pairs(self.kids[a], self.kids[b])[0]
        return self.gain(x, y)

    def _work(self, a: int, b: int) -> tuple:
        """A pair, and row by row the pairs of children that are still to be counted."""

        def rows() -> Iterator[list]:
            left, right = self._middle(self.kids[a], self.kids[b])
            right = tuple(set(right))
            for k in set(left):
                yield [(k, m) for m in right if self.gain(k, m) is None]

        return a, b, rows()

    def _children(self, x: int, y: int) -> None:
        """Count the gains of the children of two shapes whose own is known."""
        for row in self._work(x, y)[2]:
            for k, m in row:
                self.score(k, m)

    @staticmethod
    def _ends(a: tuple, b: tuple) -> tuple[int, int]:
        """Lengths of the equal head and tail of two lists: some greatest match pairs them, since no other partner of a tree gains
        more than its equal does."""
        n = min(len(a), len(b))
        head = next((i for i in range(n) if a[i] != b[i]), n)
        tail = next((i for i in range(n - head) if a[-1 - i] != b[-1 - i]), n - head)
        return head, tail

    def _middle(self, a: tuple, b: tuple) -> tuple[tuple, tuple]:
        head, tail = self._ends(a, b)
        return a[head : len(a) - tail], b[head : len(b) - tail]

    def pairs(self, a: tuple, b: tuple) -> tuple[int, list[tuple[int, int]]]:
        """The greatest number of matched nodes of two lists of siblings in order, and the places of the paired siblings.

        The gains of their shapes must have been counted.
        """
        head, tail = self._ends(a, b)
        x, y = a[head : len(a) - tail], b[head : len(b) - tail]
        score = sum(self.size[k] for k in a[:head]) + sum(self.size[k] for k in a[len(a) - tail :])
        more, middle = (0, []) if not x or not y else self._table(x, y) if len(x) * len(y) <= ARRAYS else self._rows(x, y)
        out = [(i, i) for i in range(head)] + [(i + head, j + head) for i, j in middle]
        return score + more, out + [(len(a) - tail + i, len(b) - tail + i) for i in range(tail)]

    def _table(self, a: tuple, b: tuple) -> tuple[int, list[tuple[int, int]]]:
        m, n = len(a), len(b)
        table = [[0] * (n + 1)]
        for x in a:
            above, row = table[-1], [0]
            for j, y in enumerate(b):
                best = above[j + 1] if above[j + 1] >= row[j] else row[j]
                gain = self.gain(x, y)
                if gain and above[j] + gain > best:
                    best = above[j] + gain
                row.append(best)
            table.append(row)
        i, j, out = m, n, []
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((i, j))
        return table[m][n], out[::-1]

    def _rows(self, a: tuple, b: tuple) -> tuple[int, list[tuple[int, int]]]:
        """``_table`` row by row as arrays. Every so many rows are kept; those between are made again on the way back."""
        kinds, kind_of = np.unique(np.array(b), return_inverse=True)
        kinds = kinds.tolist()
        gains: dict[int, np.ndarray] = {}

        def below(above: np.ndarray, x: int) -> np.ndarray:
            gain = gains.get(x)
            if gain is None:
                if (len(gains) + 1) * len(kinds) > GAINS:
                    gains.clear()
                gain = gains[x] = np.array([self.gain(x, y) for y in kinds], np.int64)
            row = np.zeros(len(above), np.int64)
            np.maximum.accumulate(np.maximum(above[1:], above[:-1] + gain[kind_of]), out=row[1:])
            return row

        m, n = len(a), len(b)
        step = int(m**0.5) + 1
        row = np.zeros(n + 1, np.int64)
        kept = [row]
        for i, x in enumerate(a, 1):
            row = below(row, x)
            if i % step == 0:
                kept.append(row)
        i, j, out = m, n, []
        while i and j:
            low = (i - 1) // step * step
            rows = [kept[low // step]]
            for x in a[low:i]:
                rows.append(below(rows[-1], x))
            while i > low and j:
                here, up = rows[i - low], rows[i - low - 1]
                if here[j] == up[j]:
                    i -= 1
                elif here[j] == here[j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((i, j))
        return int(row[n]), out[::-1]

    def matched(self, p: Node, r: Node) -> list[tuple[Node, Node]]:
        """The pairs of children in the greatest match of two matched nodes."""
        if p.boiler or r.boiler:
            return []
        if len(self.memo) > KEPT:
            # what was counted for other pairs of parents; what this pair needs is counted again
            self.memo.clear()
        self.score(p.shape, r.shape)
        self._children(p.shape, r.shape)
        x, y = p.frame, r.frame
        return [(x[i], y[j]) for i, j in self.pairs(self.kids[p.shape], self.kids[r.shape])[1]]


def align(page: Node, reference: Node, matcher: Matcher) -> None:
    """Give the page's matched nodes the slots of the reference's, and the others slots below 0 by their paths. Both have shapes."""
    todo = [(page, reference)]
    while todo:
        p, r = todo.pop()
        p.slot = r.slot
        pairs = matcher.matched(p, r)
        _by_path(p, {id(x) for x, _ in pairs})
        todo += pairs


def _by_path(node: Node, met) -> None:
    """Slots of all that is below the node, but for the children in ``met`` and what is below those. Markup within a line of a
    paragraph has the paragraph's slot."""
    todo = [(k, node.slot, node.tag in _PARAGRAPHS) for k in _elements(node) if id(k) not in met]
    while todo:
        k, above, line = todo.pop()
        line &= not k.holds
        k.slot = above if line else -1 - (xxhash.xxh64_intdigest(f"{above} {k.name}") >> 1)
        todo += [(x, k.slot, line or k.tag in _PARAGRAPHS) for x in _elements(k)]


def merge(reference: Node, page: Node, matcher: Matcher) -> None:
    """Insert the page's unmatched nodes into the reference, after the place of their left neighbour. Both have shapes."""
    todo = [(page, reference)]
    while todo:
        p, r = todo.pop()
        if p.boiler or r.boiler:
            continue
        pairs = matcher.matched(p, r)
        met = {id(x): y for x, y in pairs}
        kids, mine, at = [], r.frame, 0
        for k in p.frame:
            other = met.get(id(k))
            if other is None:
                kids.append(k)
                continue
            while mine[at] is not other:
                kids.append(mine[at])
                at += 1
            kids.append(other)
            at += 1
        r.kids = kids + mine[at:]
        todo += pairs


def reference_of(pages: list[str], matcher: Matcher) -> Node:
    """One tree with numbered slots and shapes from the pages of a host."""
    tree = parse(pages[0])
    for x in pages[1:]:
        page = parse(x)
        matcher.shape(tree)
        matcher.shape(page)
        merge(tree, page, matcher)
    number, todo = 0, [tree]
    while todo:
        node = todo.pop()
        node.slot = number
        number += 1
        node.kids = _elements(node)
        todo += node.kids[::-1]
    matcher.shape(tree)
    return tree


def _articles(root: Node) -> list[Node]:
    """The elements that hold the article, in page order: the outermost article elements with text, else the main ones, else none.

    Those below a vague name count only if there are no others and they hold most of the page's text.
    """
    found: list[tuple[Node, bool]] = []
    todo = [(root, False)]
    while todo:
        node, vague = todo.pop()
        if node.boiler:
            continue
        vague |= node.vague > 0
        if node.tag in ("article", "main"):
            found.append((node, vague))
            if node.tag == "article":
                continue
        todo += [(k, vague) for k in reversed(_elements(node))]
    for tag in ("article", "main"):
        some = [(x, vague, _size(x)) for x, vague in found if x.tag == tag]
        clear = [x for x, vague, n in some if n and not vague]
        if clear:
            return clear
        if some and 2 * sum(n for *_, n in some) > _size(root):
            return [x for x, _, n in some if n]
    return []


def _size(node: Node) -> int:
    total, todo = 0, [node]
    while todo:
        x = todo.pop()
        for k in x.kids:
            if k.__class__ is str:
                total += len(k)
            elif not k.boiler:
                todo.append(k)
    return total


def _titled(node: Node) -> bool:
    """Whether an h1 or h2 stands below the node."""
    todo = _elements(node)
    while todo:
        x = todo.pop()
        if x.tag in ("h1", "h2"):
            return True
        todo += [] if x.boiler else _elements(x)
    return False


def blocks(root: Node, slots_tell: bool = True) -> list[tuple[int, bool, str]]:
    """(slot, whether within the article, text) of the text blocks of the page's article, or of all of the page, in page order.

    Slots below 0 are not in the reference. A header within an article is kept if it holds a heading, since that is the
    article's title; others go. Below a vague name running text is kept: from PARAGRAPH_WORDS on in a paragraph of the article
    that has the name itself, and from PROSE_WORDS on elsewhere if ``slots_tell`` whether it varies.
    """
    out: list[tuple[int, bool, str]] = []
    parts: list[str] = []
    at = [-1, 0, 0]  # slot of the block, how vague its names are, its characters within links
    tops = _articles(root)
    inside = bool(tops)

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            least = (0, PARAGRAPH_WORDS, PROSE_WORDS)[at[1]]
            prose = not at[1] or (2 * at[2] < len(text) and text.count(" ") + 1 >= least and (at[1] == 1 or slots_tell))
            if text and prose:
                out.append((at[0], inside, text))
            parts.clear()
            at[2] = 0

    # entries: (node, vague, linked) to open, (None, ...) to close a block, (text, vague, linked, slot)
    todo: list[tuple] = [(x, 0, False) for x in reversed(tops or [root])]
    while todo:
        node, vague, linked, *slot = todo.pop()
        if node is None:
            flush()
            continue
        if node.__class__ is str:
            if not parts:
                at[0], at[1] = slot[0], vague
            at[1] = max(at[1], vague)
            at[2] += len(node) if linked else 0
            parts.append(node)
            continue
        if node.boiler or (node.vague == LOOSE and not inside) or (node.tag == "header" and (not inside or not _titled(node))):
            # what shows nothing breaks no line
            if node.tag not in _UNSEEN:
                flush()
            continue
        if node.vague > (LEAD if inside else 0):
            vague = max(vague, 1 if inside and node.tag in _PARAGRAPHS else 2)
        linked |= node.tag == "a"
        if node.tag not in _INLINE:
            flush()
            todo.append((None, 0, False))
        todo += [(k, vague, linked, node.slot) if k.__class__ is str else (k, vague, linked) for k in reversed(node.kids)]
    flush()
    return out


_BLOCKS = "array<struct<slot: long, main: boolean, text: string>>"


def seed_ids(pages: DataFrame) -> DataFrame:
    """host and h, the hash of the id and the html, of the SEEDS different pages of each host with the least hashes."""
    full = pages.where("html is not null and html <> ''").select("host", F.xxhash64("page_id", "html").alias("h")).distinct()
    # Spark's group limit leaves SEEDS rows a host and task before the exchange
    rank = F.row_number().over(Window.partitionBy("host").orderBy("h"))
    return full.withColumn("rank", rank).where(F.col("rank") <= SEEDS).select("host", "h")


def induce(pages: DataFrame) -> DataFrame:
    """page_id, url, host, blocks of every page, aligned with the reference of its host."""
    spark = pages.sparkSession
    small_batches(spark)
    keyed = pages.where("html is not null and html <> ''").withColumn("h", F.xxhash64("page_id", "html"))
    chosen = stage(seed_ids(pages), "seeds")
    n_seeds = chosen.count()
    side = F.broadcast(chosen) if n_seeds <= 400_000 else chosen
    # equal rows become one before the exchange, so a host gathers at most SEEDS pages
    seeds = stage(keyed.join(side, ["host", "h"]).select("host", "h", "html").groupBy("host").agg(F.transform(F.array_sort(F.collect_set(F.struct("h", "html"))), lambda x: x["html"]).alias("htmls")), "references")
    size = seeds.select(F.sum(F.aggregate("htmls", F.lit(0).cast("long"), lambda a, x: a + F.length(x)))).first()[0] or 0
    if size * 2 <= BROADCAST_BYTES:
        sources = {r.host: list(r.htmls) for r in seeds.collect()}
        shared = spark.sparkContext.broadcast(sources)
        rows = pages.select("page_id", "url", "host", "html")
    else:
        shared = None
        salt = F.explode(F.sequence(F.lit(0), F.lit(31)))
        rows = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(32)).cast("int")).join(seeds.withColumn("salt", salt), ["host", "salt"], "left").select("page_id", "url", "host", "html", "htmls")
    trees: dict[str, tuple[Node, bool]] = {}
    matchers: list[Matcher] = []

    def one(batch: pa.RecordBatch) -> dict:
        hosts, sources_ = batch.column(2).to_pylist(), batch.column(4).to_pylist() if shared is None else None
        out = []
        for k, source in enumerate(batch.column(3).to_pylist()):
            host = hosts[k]
            if not source:
                out.append([])
                continue
            if not matchers or matchers[0].full() or len(trees) > 200:
                matchers[:] = [Matcher()]
                trees.clear()
            if host not in trees:
                found = (shared.value.get(host) if shared is not None else sources_[k]) or [source]
                trees[host] = reference_of(found, matchers[0]), len(found) >= FEW_PAGES
            tree, slots_tell = trees[host]
            page = parse(source)
            matchers[0].shape(page)
            align(page, tree, matchers[0])
            out.append([{"slot": s, "main": m, "text": t} for s, m, t in blocks(page, slots_tell)])
        return {"page_id": batch.column(0), "url": batch.column(1), "host": batch.column(2), "blocks": out}

    return arrow_map(rows, one, f"page_id long, url string, host string, blocks {_BLOCKS}")


def text_key(host, slot, text) -> Column:
    """What a text in a slot of a host is known by."""
    return F.xxhash64(host, slot, text)


def template_texts(aligned: DataFrame) -> DataFrame:
    """host and t, the ``text_key`` of each of its template texts, from the texts of all pages."""
    texts = aligned.select("host", F.xxhash64("blocks").alias("page"), F.explode("blocks").alias("b"))
    texts = texts.select("host", "page", F.col("b.slot").alias("slot"), F.col("b.main").alias("main"), text_key(F.col("host"), F.col("b.slot"), F.col("b.text")).alias("t"))
    # pages with equal blocks count once; a slot that a page fills more than once counts each text
    texts = texts.distinct()
    each = texts.groupBy("host", "slot", "t").agg(F.count("*").alias("n"), F.max("main").alias("main"))
    once = texts.groupBy("host", "slot", "page").agg(F.count("*").alias("k"))
    pages = once.groupBy("host", "slot").agg(F.count("*").alias("pages"), F.sum("k").alias("total"))
    # hosts may be null
    slots = pages.select(F.col("host").alias("_host"), F.col("slot").alias("_slot"), "pages", "total")
    hosts = texts.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("host_pages")).select(F.col("host").alias("_of"), "host_pages")
    often = each.where(F.col("n") >= FEW_PAGES).join(slots, F.col("host").eqNullSafe(F.col("_host")) & (F.col("slot") == F.col("_slot")))
    often = often.join(hosts, F.col("host").eqNullSafe(F.col("_of")))
    share = ~F.col("main") & (F.col("n") >= MIN_PAGES) & (F.col("n") >= SHARE * F.col("pages"))
    outside = (F.col("n") == F.col("total")) | ((F.col("n") >= MIN_PAGES) & (F.col("n") > CONSTANT * F.col("pages")))
    alone = F.when(F.col("main"), F.col("n") >= EVERYWHERE * F.col("host_pages")).otherwise(outside)
    # at most a few texts of a slot are left here
    some = often.where(alone | share).groupBy("host", "slot", "total").agg(F.collect_list(F.struct("t", alone.alias("alone"), share.alias("share"), "n")).alias("found"))
    together = F.aggregate(F.filter("found", lambda x: x["share"]), F.lit(0).cast("long"), lambda a, x: a + x["n"]) > CONSTANT * F.col("total")
    return some.select("host", F.explode(F.filter("found", lambda x: x["alone"] | (x["share"] & together))).alias("x")).select("host", F.col("x.t").alias("t"))


def content(aligned: DataFrame, template: DataFrame) -> DataFrame:
    """page_id, url, blocks and main (the texts that are no template) of every page of ``aligned`` (uid, page_id, url, host, blocks)."""
    total, most = template.groupBy("host").agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).first()
    if (total or 0) <= BROADCAST_TEXTS and (most or 0) <= HOST_TEXTS:
        by_host = template.groupBy("host").agg(F.collect_set("t").alias("template"))
        kept = F.filter("blocks", lambda b: ~F.array_contains("template", text_key(F.col("host"), b["slot"], b["text"])))
        main = F.transform(F.when(F.col("template").isNull(), F.col("blocks")).otherwise(kept), lambda b: b["text"])
        return aligned.join(F.broadcast(by_host), "host", "left").select("page_id", "url", "blocks", main.alias("main"))
    # block by block; the keys of texts that stand on very many pages are salted
    salts = 32
    each = aligned.select("uid", "host", F.posexplode("blocks").alias("pos", "b")).select("uid", "pos", F.pmod("uid", F.lit(salts)).cast("int").alias("salt"), text_key(F.col("host"), F.col("b.slot"), F.col("b.text")).alias("t"), F.col("b.text").alias("text"))
    rest = each.join(template.select("t").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["t", "salt"], "left_anti")
    left = rest.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("main"))
    return aligned.join(left, "uid", "left").select("page_id", "url", "blocks", F.coalesce("main", F.array().cast("array<string>")).alias("main"))


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_template_blocks of every page."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(source).cast("string").alias("html"))
    rows = rows.withColumn("host", split_url(F.col("url"))[0])
    aligned = stage(induce(rows).withColumn("uid", F.monotonically_increasing_id()), "aligned")
    found = content(aligned, stage(template_texts(aligned), "template"))
    text = F.array_join("main", "\n")
    return found.select("page_id", "url", text.alias("text"), F.char_length(text).cast("long").alias("n_chars"), F.size("blocks").cast("long").alias("n_blocks"), (F.size("blocks") - F.size("main")).cast("long").alias("n_template_blocks"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(parquet(spark, sf_dir, "pages"))
