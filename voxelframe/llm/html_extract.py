"""HTML extraction: flat text blocks classified by a decision tree.

The markup is scanned once.  Block elements cut the text into flat blocks; inline elements don't.  A small decision
tree, trained on `LABELLED`, says from a block's word count and link density and those of the blocks before and after
it (excluded ones, too) whether it is main text.  It knows no element names: text counts as main text in an <article>
as in a <div>, and lists of links don't.

What the page itself declares to be something else is excluded, whatever the tree says: menus, footers, sidebars,
forms, dialogs and headers outside the article, by element; and elements whose class, id or role is a word of
`BOILER_WORDS`, or is made of such words and of `QUALIFIERS` only ("comment-list", but not "legal-news"), or that are
hidden (an article or main element: of words of readers' comments only; the body: never).  A marked element ends as any of its kind: a paragraph with the next block, an item with the next item, an
inline element with its own end tag.

Defined cases: null and empty html give an empty text; comments, scripts, styles and other raw elements are skipped,
to the end of the page if they aren't closed; drawings, players, embedded objects, lists of choices and templates are
skipped to their end tag or that of an element around them, and are empty if they close themselves; formulas are
text, without their annotations; unclosed tags and pages cut off are read as far as they go; character references
are decoded, white space inside a block becomes one blank; repeated rows get equal results; other columns pass
through, whatever their names, except that an input column with the name of a new one is replaced.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .columns import kept, spare

#: Element kinds of HTML.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Elements whose markup is read, but whose text is none of the page's.
SKIPPED = frozenset("template object select canvas audio video annotation annotation-xml".split())
#: Skipped, too; raw elements don't exist in it, and any element may close itself.
FOREIGN = frozenset({"svg"})
MATH = frozenset("math semantics maction merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover".split())
INLINE = MATH | frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr output q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end is often left out: they stay out of the stack unless they are marked.
LOOSE = frozenset("p li dt dd tr td th thead tbody tfoot colgroup option html head body".split())
#: The open loose elements that a new one ends, and where the search for them stops.
ENDS = {
    "li": ("li", "ul ol menu dir"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "td": ("td th", "table"),
    "th": ("td th", "table"),
    "tr": ("tr td th", "table"),
    "thead": ("thead tbody tfoot tr td th", "table"),
    "tbody": ("thead tbody tfoot tr td th", "table"),
    "tfoot": ("thead tbody tfoot tr td th", "table"),
}
BOILER_TAGS = frozenset("nav footer aside form button fieldset dialog menu head".split())
MAIN_TAGS = frozenset("article main".split())
#: Words of a class, id or role that mark what is no main text.
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup popup modal overlay"
    " sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments commentlist reply replies respond disqus related recommended share sharing social toolbar pagination pager"
    " widget login search skip copyright legal contentinfo complementary dialog tooltip toc tags hidden".split()
)
#: These may stand beside words of BOILER_WORDS in a marking name; alone they mark nothing.
QUALIFIERS = frozenset("site page main top bottom left right primary secondary header head body content text wrapper wrap container box inner outer area block section list item items group row unit slot link links button buttons icon icons form bar panel bg global mobile desktop the js".split())
#: Of an article or main element only these mark it.
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond disqus".split())

_ATTRS = r"""(?>[^<>"']+|"[^"]*"|'[^']*')*+"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<tag>[a-z][^\s/>]*)(?:(?P<attrs>{_ATTRS})>|(?P<rest>[^>]*)(?:>|\Z))",
    re.S | re.I,
)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW}
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
_PART = re.compile(r"[A-Z]?[^\W\dA-Z_]+|[A-Z]+(?![a-z])|\d+")


@dataclass(slots=True)
class Block:
    text: str
    words: int
    link_words: int
    excluded: bool


@dataclass(slots=True)
class Open:
    """An open element of the stack."""

    tag: str
    excluded: bool = False
    main: bool = False
    skip: int = 0  # 1: its text is none of the page's; 2: so, and it is a drawing
    loose: bool = False  # inline, or its end is often left out
    depth: int = 0  # elements of the same name inside that stay out of the stack


def _marked(tag: str, attrs: str) -> bool:
    """Whether an element's attributes mark it as no main text."""
    if not attrs or tag in ("html", "body"):
        return False
    known = COMMENT_WORDS if tag in MAIN_TAGS else BOILER_WORDS
    values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
    for name in " ".join(values.get(k, "") for k in ("class", "id", "role")).split():
        parts = [p.lower() for p in _PART.findall(name)]
        if any(p in known for p in parts) and all(p in known or p in QUALIFIERS or p.isdigit() for p in parts):
            return True
    hidden = "hidden" in values or values.get("aria-hidden", "").lower() == "true" or _NOT_SHOWN.search(values.get("style", ""))
    return tag not in MAIN_TAGS and bool(hidden)


class _Scan:
    """One pass over a page's markup."""

    def __init__(self) -> None:
        self.out: list[Block] = []
        self.stack = [Open("")]
        self.places: dict[str, list[int]] = {}  # of the open elements of each name in the stack
        self.inner: dict[str, int] = {}  # open elements of the skipped one that stay out of the stack
        self.link = False
        self.parts: list[str] = []
        self.linked: list[str] = []

    def cut(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.out.append(Block(text, text.count(" ") + 1, len("".join(self.linked).split()), self.stack[-1].excluded))
            self.parts.clear()
            self.linked.clear()

    def take(self, raw: str) -> None:
        if raw and not self.stack[-1].skip:
            s = entities.unescape(raw) if "&" in raw else raw
            self.parts.append(s)
            if self.link:
                self.linked.append(s)

    def push(self, tag: str, **more) -> None:
        top = self.stack[-1]
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append(Open(tag, **({"excluded": top.excluded, "main": top.main, "skip": top.skip} | more)))

    def find(self, tags: str, until: str = "") -> int:
        """The place in the stack of the innermost element of one of these names, 0 if there is none before `until`."""
        last = lambda names: max((p[-1] for t in names.split() if (p := self.places.get(t))), default=0)
        i = last(tags)
        return i if i > last(until) else 0

    def close(self, i: int) -> None:
        """Ends the element at a place of the stack and those in it; none at place 0."""
        while 0 < i < len(self.stack):
            self.places[self.stack.pop().tag].pop()

    def inline(self, tag: str, ends: bool, attrs: str) -> None:
        if tag == "a":
            self.link = not ends
            self.linked.append(" ")
        if tag in VOID:
            return
        i = self.find(tag, "article main body td th") if self.marked_inline else 0
        if ends and i and not self.stack[i].depth:
            self.cut()
            self.close(i)
            self.marked_inline -= 1
        elif ends and i:
            self.stack[i].depth -= 1
        elif not ends and attrs and not attrs.rstrip().endswith("/") and _marked(tag, attrs):
            self.cut()  # a marked inline element is a block of its own
            self.push(tag, excluded=True, loose=True)
            self.marked_inline += 1
        elif not ends and i and not attrs.rstrip().endswith("/"):
            self.stack[i].depth += 1

    marked_inline = 0  # marked inline elements that were opened and not closed by their own end tags

    def block(self, tag: str, ends: bool, attrs: str) -> None:
        self.link = False
        top = self.stack[-1]
        if top.loose and top.tag == "p":  # any block ends a paragraph
            self.close(len(self.stack) - 1)
        if tag in LOOSE:
            others, until = ENDS.get(tag, (tag, "article main table"))
            while i := self.find(tag if ends else others, until):
                self.close(i)
                if ends:
                    break
            if not ends and attrs and _marked(tag, attrs):
                self.push(tag, excluded=True, loose=True)
        elif ends:
            self.close(self.find(tag))
        elif not attrs.rstrip().endswith("/"):
            top = self.stack[-1]
            out = tag in BOILER_TAGS or (tag == "header" and not top.main) or _marked(tag, attrs)
            self.push(tag, excluded=top.excluded or out, main=top.main or tag in MAIN_TAGS)

    def skipped(self, tag: str, ends: bool, attrs: str) -> bool:
        """Inside or at the begin of a skipped element; false for the end of an element around it, which is as any other."""
        top, empty = self.stack[-1], attrs.rstrip().endswith("/")
        if top.skip and (tag in INLINE or tag in LOOSE) and tag not in VOID:
            if not ends:
                self.inner[tag] = self.inner.get(tag, 0) + (not empty)
                return True
            if self.inner.get(tag):
                self.inner[tag] -= 1
                return True
            while self.stack[-1].skip:
                self.close(len(self.stack) - 1)
            return False
        if not top.skip and tag not in SKIPPED and tag not in FOREIGN:
            return False
        self.cut()
        i = self.find(tag) if ends and top.skip else 0
        if i and not self.stack[i].skip:
            return False
        if i:
            self.close(i)
        elif not ends and tag not in VOID and not empty:
            if not top.skip:
                self.inner.clear()
            self.push(tag, skip=2 if tag in FOREIGN else 1 if tag == "foreignobject" else top.skip or 1)
        return True

    def run(self, page: str) -> list[Block]:
        at = 0
        while m := _TOKEN.search(page, at):
            self.take(page[at : m.start()])
            at = m.end()
            if m["tag"] is None:
                if m[0].startswith("<![CDATA["):
                    self.cut()
                continue
            tag, ends, attrs = m["tag"].lower(), bool(m["close"]), m["attrs"] or m["rest"] or ""
            if tag in RAW and not ends and self.stack[-1].skip < 2:
                self.cut()
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else len(page)
            elif (self.stack[-1].skip or tag in SKIPPED or tag in FOREIGN) and self.skipped(tag, ends, attrs):
                pass
            elif tag == "br":
                self.take(" ")
            elif tag in INLINE:
                self.inline(tag, ends, attrs)
            else:
                self.cut()
                if tag in VOID:
                    self.link = False
                else:
                    self.block(tag, ends, attrs)
        self.take(page[at:])
        self.cut()
        return self.out


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in page order."""
    return _Scan().run(page)


FEATURES = ("words", "link density", "words before", "link density before", "words after", "link density after")


def features(found: list[Block]) -> list[tuple[float, ...]]:
    density = [min(1.0, b.link_words / b.words) for b in found]
    words = [b.words for b in found]
    w, d = [0, *words, 0], [0.0, *density, 0.0]
    return [(words[i], density[i], w[i], d[i], w[i + 2], d[i + 2]) for i in range(len(found))]


#: Labelled blocks, in the order of FEATURES, with 1 for main text.
LABELLED = (
    # paragraphs and headings of articles, long and short
    ((120, 0.00, 80, 0.00, 95, 0.00), 1),
    ((60, 0.00, 5, 0.00, 70, 0.00), 1),
    ((140, 0.02, 33, 0.00, 12, 0.00), 1),
    ((35, 0.05, 60, 0.00, 20, 0.00), 1),
    ((25, 0.12, 30, 0.10, 9, 0.00), 1),
    ((7, 0.00, 10, 0.00, 60, 0.00), 1),
    ((1, 0.00, 40, 0.00, 55, 0.00), 1),
    ((3, 0.00, 2, 0.00, 2, 0.00), 1),
    ((1, 0.00, 1, 0.00, 1, 0.00), 1),
    ((80, 0.30, 7, 0.00, 41, 0.05), 1),
    ((18, 0.25, 45, 0.00, 0, 0.00), 1),
    ((2, 0.00, 0, 0.00, 0, 0.00), 1),
    # the first and the last block beside lists of links
    ((5, 0.00, 1, 1.00, 100, 0.00), 1),
    ((2, 0.00, 1, 1.00, 3, 0.00), 1),
    ((1, 0.00, 3, 1.00, 1, 0.00), 1),
    ((40, 0.00, 22, 0.00, 2, 1.00), 1),
    ((4, 0.00, 6, 0.00, 8, 0.90), 1),
    ((1, 0.00, 2, 0.00, 1, 1.00), 1),
    ((50, 0.00, 3, 1.00, 2, 1.00), 1),
    ((12, 0.00, 1, 1.00, 4, 1.00), 1),
    ((30, 0.10, 1, 1.00, 1, 1.00), 1),
    ((22, 0.20, 2, 1.00, 6, 0.80), 1),
    # references inside articles: linked for a good part, between paragraphs
    ((25, 0.45, 70, 0.00, 38, 0.00), 1),
    ((40, 0.50, 55, 0.05, 62, 0.00), 1),
    ((12, 1.00, 70, 0.00, 45, 0.00), 1),
    ((1, 1.00, 50, 0.00, 30, 0.00), 1),
    ((6, 0.80, 33, 0.10, 48, 0.00), 1),
    ((9, 0.60, 90, 0.00, 26, 0.10), 1),
    # words between links: rules, counts and captions of menus
    ((1, 0.00, 1, 1.00, 1, 1.00), 0),
    ((2, 0.00, 3, 1.00, 2, 1.00), 0),
    ((3, 0.00, 2, 1.00, 5, 1.00), 0),
    ((1, 0.00, 8, 0.90, 6, 0.75), 0),
    ((4, 0.20, 2, 1.00, 3, 1.00), 0),
    # lists of links
    ((1, 1.00, 1, 1.00, 1, 1.00), 0),
    ((3, 1.00, 2, 1.00, 4, 1.00), 0),
    ((2, 1.00, 0, 0.00, 1, 1.00), 0),
    ((1, 1.00, 1, 1.00, 12, 0.00), 0),
    ((4, 1.00, 2, 1.00, 90, 0.00), 0),
    ((2, 1.00, 60, 0.00, 3, 1.00), 0),
    ((5, 1.00, 14, 0.00, 2, 1.00), 0),
    ((6, 0.70, 5, 1.00, 8, 0.70), 0),
    ((12, 0.90, 30, 0.00, 3, 1.00), 0),
    ((25, 0.80, 6, 1.00, 8, 0.70), 0),
    ((40, 0.85, 5, 0.00, 30, 0.90), 0),
    ((60, 0.95, 12, 1.00, 20, 0.90), 0),
    ((9, 0.60, 4, 1.00, 5, 0.70), 0),
    # a link that stands alone: beside nothing, or beside scraps of text
    ((3, 1.00, 0, 0.00, 0, 0.00), 0),
    ((2, 1.00, 3, 0.00, 4, 0.00), 0),
    ((4, 1.00, 0, 0.00, 70, 0.00), 0),
    ((3, 1.00, 65, 0.00, 0, 0.00), 0),
    ((5, 0.80, 6, 0.00, 35, 0.00), 0),
    ((7, 0.60, 42, 0.00, 5, 0.00), 0),
)

Tree = tuple  # (feature, most, if at most, else) or (label,)


def _impurity(rows: list) -> float:
    p = sum(y for _, y in rows) / len(rows)
    return len(rows) * p * (1 - p)


def fit_tree(rows: tuple = LABELLED, depth: int = 6) -> Tree:
    """A binary tree by least Gini impurity; ties go to the earlier feature and the smaller border."""
    rows = list(rows)
    ones = sum(y for _, y in rows)
    if depth == 0 or ones in (0, len(rows)):
        return (int(2 * ones >= len(rows)),)
    best = None
    for f in range(len(rows[0][0])):
        values = sorted({x[f] for x, _ in rows})
        for a, b in zip(values, values[1:], strict=False):
            border = (a + b) / 2
            left, right = [r for r in rows if r[0][f] <= border], [r for r in rows if r[0][f] > border]
            cost = _impurity(left) + _impurity(right)
            if best is None or cost < best[0] - 1e-9:
                best = (cost, f, border, left, right)
    if best is None or best[0] >= _impurity(rows) - 1e-9:
        return (int(2 * ones >= len(rows)),)
    _, f, border, left, right = best
    return (f, border, fit_tree(tuple(left), depth - 1), fit_tree(tuple(right), depth - 1))


def classify(tree: Tree, x: tuple[float, ...]) -> int:
    while len(tree) > 1:
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def main_text(page: str | None, tree: Tree) -> tuple[str, int, int]:
    """The main text, and the numbers of blocks and of those kept."""
    if not page:
        return "", 0, 0
    found = blocks(page)
    main = [b.text for b, x in zip(found, features(found), strict=True) if classify(tree, x) and not b.excluded]
    return " ".join(main), len(found), len(main)


def text_of(page: Column, tree: Tree | None = None) -> Column:
    """struct(text, n_blocks, n_kept) for a column of html."""
    tree = tree or fit_tree()

    def f(col: pa.Array) -> pa.Array:
        got = [main_text(v.as_py(), tree) for v in col]
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())], ["text", "n_blocks", "n_kept"])

    return arrow_udf(f, "text string, n_blocks bigint, n_kept bigint").asNondeterministic()(page)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", tree: Tree | None = None) -> DataFrame:
    """`pages` with the main text, n_chars (its code points), n_blocks and n_kept."""
    mark, own = spare(pages, "html_extract"), kept(pages, (text_col, "n_chars", "n_blocks", "n_kept"))
    q = F.col(mark)
    return pages.select(*own, text_of(F.col(f"`{html_col}`"), tree).alias(mark)).select(*own, q.text.alias(text_col), F.length(q.text).cast("long").alias("n_chars"), q.n_blocks.alias("n_blocks"), q.n_kept.alias("n_kept"))
