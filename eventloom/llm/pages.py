"""Main text of web pages by two-pass block rules.

The page is read as a stream of tags; block-level tags cut it into blocks of text. Elements that never hold an article
(scripts, forms, navigation, footers) are left out with all they hold. A container whose class, id or role names such a
use votes against its blocks; prose, or inside an article few links, outweighs a name of the layout, and no name stands
against an element with the article in it. The first pass classifies each block by its stop-word density, length and link density as good, bad, short or
near good; the second lets the undecided blocks take the label of their nearest decided neighbours. Where the page marks
its article, the mark is a weight: blocks inside an article, or a main set apart from the rest of the page, are raised
and its edges count as good, so only a menu is left out; a main around the whole page only raises. Blocks outside are bad
unless the mark is a teaser beside much more text. A mark without text is none.

Defined cases: null and empty pages have no text; unclosed and stray tags are tolerated; character references without
a meaning stay as they are; ties between neighbours go to the earlier one.
"""

from __future__ import annotations

import re
from html import unescape
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, table

# Element names.
SKIPPED = frozenset("script style noscript template svg math iframe object canvas select textarea button nav footer aside form head title menu dialog audio video map datalist".split())
RAW = frozenset("script style noscript template textarea title iframe svg math".split())
ENDLESS = frozenset("script style title textarea".split())  # without an end tag these run to the end of the page
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article blockquote body caption center dd details dir div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = "ul ol table div article section main blockquote dl body".split()
SECTIONS = "article main body div section".split()
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words of class, id and role that name what is not the article. Those of another use often hold prose of
# their own; those of the layout seldom do, so prose in such an element speaks against its name.
OTHER_USE = "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments respond reply replies disqus cookie cookies consent gdpr popup modal newsletter subscribe subscription signup copyright"
LAYOUT = (
    "banner discussion sidebar side aside widget related recommended menu nav navbar navigation breadcrumb breadcrumbs footer foot masthead topbar notice notices alert overlay share sharing social pagination pager toolbar login search "
    "complementary contentinfo dialog toc skip legal"
)
# Frequent words of the four languages.
STOP_WORDS = frozenset(
    """the of and to in a is that it was for on are as with be by an from or this at not have his they which one you had but
    de la le et les des en un une du est que dans qui pour par sur au avec il elle ne pas ce se plus ou
    der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat
    el los las del y por con para una su al lo como más pero sus le ya o este sí porque""".split()
)
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>?|<\?[^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|$)", re.S)
NAMED = re.compile(r"(?:^|[\s\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
OTHER_NAMES, LAYOUT_NAMES, ARTICLE_NAMES = (re.compile(rf"(?:^|[\s_-])(?:{w.replace(' ', '|')})(?:$|[\s_-])") for w in (OTHER_USE, LAYOUT + " header", LAYOUT))
ABSENT = re.compile(r"(?:^|(?<=[\s_-]))(?:no|not|with|without|has)[_-]\S*")  # no-sidebar, layout_with-toc: the page's form, not a use
HIDDEN = re.compile(r"(?:^|\s)hidden(?:$|[\s=/])|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
WORD = re.compile(r"[^\W\d_]+")
LINK_HIGH, LENGTH_LOW, LENGTH_HIGH, STOPS_LOW, STOPS_HIGH = 0.2, 70, 200, 0.10, 0.18
DEEP = 16


class Block:
    __slots__ = ("parts", "links", "linked", "heading", "inside", "label", "votes", "marks", "text")

    def __init__(self, heading: str, inside: int, marks: tuple):
        self.parts, self.links, self.linked, self.heading, self.inside, self.label, self.votes, self.marks, self.text = [], [], 0, heading, inside, "", None, marks, ""

    def share(self) -> float:
        """The part of the text that is links."""
        return self.linked / max(1, len(self.text))


class Element:
    """An open or closed element that marks the article, or whose names vote against what it holds."""

    __slots__ = ("depth", "strength", "inside", "under", "blocks")

    def __init__(self, depth: int, strength: int, inside: bool, under: tuple):  # a mark's strength: 2 article, 1 main
        self.depth, self.strength, self.inside, self.under, self.blocks = depth, strength, inside, under, []

    def size(self) -> int:
        return sum(len(b.text) for b in self.blocks)


def _unwanted(name: str, attributes: str, in_article: bool) -> bool:
    if name in SKIPPED or (name == "header" and not in_article):
        return True
    return bool(attributes) and name not in ("html", "body", "article", "main") and HIDDEN.search(attributes) is not None


def _vote(name: str, attributes: str, in_article: bool) -> int:
    """Strength of the vote of an element's names: 0, 1 (layout) or 2 (another use). Inside an article, names of
    headings, paragraphs and headers and anchors of sections tell its content."""
    if not attributes or name in ("html", "body", "article", "main") or in_article and (name in HEADINGS or name in ("p", "header")):
        return 0
    strength = 0
    for kind, a, b, c in NAMED.findall(attributes):
        if in_article and name == "section" and kind.lower() == "id":
            continue
        names = ABSENT.sub("", unescape(a or b or c).lower())
        if OTHER_NAMES.search(names):
            return 2
        if (ARTICLE_NAMES if in_article else LAYOUT_NAMES).search(names):
            strength = 1
    return strength


def _prose(blocks: list[Block]) -> bool:
    """Whether blocks hold long text with few links."""
    return sum(len(b.text) for b in blocks if len(b.text) >= LENGTH_LOW and b.share() <= LINK_HIGH) > LENGTH_HIGH


def _without_named(blocks: list[Block], votes: list[Element], marks: list[Element]) -> list[Block]:
    """Blocks against which no vote stands. No vote stands against the article: an element with a large mark of it."""
    if not votes:
        return blocks
    for b in blocks:
        for e in (*b.votes, *b.marks):
            e.blocks.append(b)
    own = [m for m in marks if all(v.strength < 2 for v in m.under)] or marks
    most = max((m.size() for m in own), default=0)
    held = {v for m in own if 2 * m.size() >= most > 0 for v in m.under}
    stand = set()
    for v in votes:
        if v.blocks and v not in held:
            few = sum(b.linked for b in v.blocks) <= LINK_HIGH * v.size()
            if v.strength == 2 or not (_prose(v.blocks) or v.inside and few):
                stand.add(v)
    while True:
        left = [b for b in blocks if not any(v in stand for v in b.votes)]
        if any(b.inside for b in left) or _prose(left):
            return left
        # Names alone do not empty a page: the outermost elements that hold prose are what it is about.
        outer = [v for v in stand if not any(u in stand for u in v.under) and _prose(v.blocks)]
        if not outer:
            return left
        stand.difference_update(outer)


def blocks_of(html: str) -> tuple[list[Block], bool, bool]:
    """Blocks of the page in order, whether elements of the page's frame were left out, and whether it has those or blocks
    around what it marks as its article."""
    out: list[Block] = []
    stack: list[str] = []
    depths: dict[str, list[int]] = {}  # of the open elements of each name, so no tag searches the stack
    skip = None  # depth below which everything is left out
    links = articles = 0
    current: Block | None = None
    around = False
    votes: list[Element] = []
    marks: list[Element] = []
    voting: tuple[Element, ...] = ()  # open elements; so deep that more of them tell nothing new
    marking: tuple[Element, ...] = ()
    unended: set[str] = set()  # elements of RAW without an end tag in the rest of the page
    at = 0

    def add(text: str) -> None:
        nonlocal current
        if skip is None and text:
            if current is None:
                current = Block(next((t for t in stack[-3:] if t in HEADINGS), ""), max((m.strength for m in marking), default=0), marking)
                out.append(current)
            text = unescape(text)
            current.parts.append(text)
            if current.votes != voting and not text.isspace():
                # A vote is against a whole block: what is named within one is part of its sentence.
                current.votes = voting if current.votes is None else tuple(v for v in current.votes if v in voting)
            if links:
                current.links.append(text)

    def close(k: int) -> None:
        nonlocal links, articles, voting, marking
        gone = stack[k:]
        del stack[k:]
        for t in gone:
            depths[t].pop()
        links -= gone.count("a")
        articles -= gone.count("article") + gone.count("main")
        while voting and voting[-1].depth >= k:
            voting = voting[:-1]
        while marking and marking[-1].depth >= k:
            marking = marking[:-1]

    def deepest(names) -> int:
        """Depth of the innermost open element of these names, -1 without one."""
        return max((depths[t][-1] for t in names if depths.get(t)), default=-1)

    while True:
        m = TOKEN.search(html, at)
        if not m:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in BLOCKS:
            current = None
        if name == "br":
            add(" ")
            continue
        if name in VOID:
            continue
        if not closing:
            if name in RAW:
                if name in ("svg", "math") and m[3].endswith("/") or name in unended:
                    continue
                end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
                if end or name in ENDLESS:
                    at = end.end() if end else len(html)
                else:
                    unended.add(name)  # only the tag is left out
                continue
            if name in ("p", "li", "td", "tr", "dd", "dt", "option"):
                # An open element of the same name ends where its sibling begins, unless a container stands between.
                if (k := deepest((name,))) > deepest(CONTAINERS):
                    close(k)
                if skip is not None and len(stack) <= skip:
                    skip = None
            if m[3].endswith("/") and name not in BLOCKS:
                continue
            if skip is None and _unwanted(name, m[3], articles > 0):
                skip = len(stack)
                around = around or not articles and name in ("nav", "header", "footer", "aside")
                current = None
            if skip is None and len(voting) < DEEP and (strength := _vote(name, m[3], articles > 0)):
                votes.append(Element(len(stack), strength, articles > 0, voting))
                voting += (votes[-1],)
            depths.setdefault(name, []).append(len(stack))
            stack.append(name)
            links += name == "a"
            if name in ("article", "main"):
                articles += 1
                if skip is None and len(marking) < DEEP:
                    marks.append(Element(len(stack) - 1, 2 if name == "article" else 1, True, voting))
                    marking += (marks[-1],)
        elif (k := deepest((name,))) >= 0:
            if name not in BLOCKS and name not in SKIPPED and deepest(SECTIONS) > k:
                continue  # a stray inline end does not close containers
            close(k)
            if skip is not None and len(stack) <= skip:
                skip = None
                current = None
    for b in out:
        b.text = " ".join("".join(b.parts).split())
        b.linked = len(" ".join("".join(b.links).split()))
    out = [b for b in out if b.text]
    return _without_named(out, votes, marks), around, around or any(not b.inside for b in out)


def _menus(blocks: list[Block]) -> set[Block]:
    """Blocks of links that open a marked element, two at least and before anything else in it."""
    out: set[Block] = set()
    for _, group in groupby((b for b in blocks if b.inside), key=lambda b: b.marks[:1]):
        held = list(group)
        n = next((i for i, b in enumerate(held) if b.heading or b.share() <= 0.5), 0)
        if n > 1:
            out.update(held[:n])
    return out


def _free(b: Block, framed: bool) -> str:
    """The label of the first pass: by links, length and stop-word density. Where the page's frame was left out, text
    without links and with few stop words is ambiguous, not bad."""
    words = WORD.findall(b.text.lower())
    density = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if b.share() > LINK_HIGH:
        return "bad"
    if len(b.text) < LENGTH_LOW:
        return "short" if not b.linked else "bad"
    if density >= STOPS_HIGH:
        return "good" if len(b.text) > LENGTH_HIGH else "near"
    return "near" if density >= STOPS_LOW else "short" if framed and not b.linked else "bad"


def _weigh(blocks: list[Block], around: bool) -> bool:
    """Set ``inside`` to the weight of each block's mark; returns whether blocks without a mark are still open.

    A mark is a teaser if the good blocks outside hold more than twice its text: it loses its weight, unless it has the
    page's only h1; then it and what is outside both count, where that is more than one block."""

    def teaser(level: int) -> bool:
        own, good = [b for b in blocks if b.inside >= level], [b for b in blocks if b.inside < level and b.label == "good"]
        titled = any(b.heading == "h1" for b in own) and not any(b.heading == "h1" and b.inside < level for b in blocks)
        if not own or sum(len(b.text) for b in good) <= 2 * sum(len(b.text) for b in own) or titled and len(good) == 1:
            return False
        if not titled:
            for b in own:
                b.inside = int(level == 2 and any(m.strength == 1 for m in b.marks))
        return True

    unsettled = teaser(2) and not any(b.inside == 1 for b in blocks)
    unsettled = teaser(1) or unsettled
    if around and not any(b.inside == 2 for b in blocks):
        for b in blocks:
            b.inside *= 2  # main set apart from the rest of the page is as good as an article
    return unsettled or not any(b.inside for b in blocks)


def _second_pass(blocks: list[Block], around: bool) -> None:
    """Undecided blocks take the labels of their nearest decided neighbours. The edge of an article counts as good. That
    of the page counts as bad, but where navigation, headers or footers were left out ``around`` the blocks it tells
    nothing: there the one neighbour decides."""
    first = [b.label for b in blocks]
    decided = ("good", "bad")
    before, after, last = [""] * len(blocks), [""] * len(blocks), ""
    for i, x in enumerate(first):
        before[i] = last
        last = x if x in decided else last
    last = ""
    for i in range(len(first) - 1, -1, -1):
        after[i] = last
        last = first[i] if first[i] in decided else last
    for i, b in enumerate(blocks):
        if first[i] in ("short", "near"):
            edge = "good" if b.inside == 2 else "" if around and not b.inside else "bad"
            left, right = before[i] or edge, after[i] or edge
            left, right = left or right or "bad", right or left or "bad"
            if b.heading:
                b.label = right
            elif left == right:
                b.label = left
            else:
                b.label = "good" if b.inside == 2 or first[i] == "near" or "near" in first[max(0, i - 1) : i + 2] else "bad"


def classify(blocks: list[Block], framed: bool, around: bool) -> None:
    """First pass, free of context, then the second; a mark of the article raises what it holds, and blocks outside it
    are bad unless it is a teaser."""
    for b in blocks:
        b.label = _free(b, framed)
    if framed and not any(b.label == "good" for b in blocks):
        for b in blocks:  # a page of short prose: its best blocks decide
            b.label = "good" if b.label == "near" else b.label
    unsettled = _weigh(blocks, around)
    menus = _menus([b for b in blocks if b.inside == 2])

    def label(b: Block) -> str:
        if not b.inside:
            return b.label if unsettled else "bad"
        if b in menus or b.inside == 1 and b.share() > 0.5 and not b.heading:
            return "bad"
        return b.label if b.label != "bad" else "near" if len(b.text) >= LENGTH_LOW else "short"

    labels = [label(b) for b in blocks]
    if not unsettled and "good" not in labels and not any(b.inside == 2 for b in blocks):
        # Main without any good block: its mark is all there is to go by.
        for b in blocks:
            b.inside *= 2
    for b, x in zip(blocks, labels, strict=True):
        b.label = x
    for _, group in groupby(blocks, key=lambda b: b.inside and b.marks[:1]):
        _second_pass(list(group), framed)


def main_text(html: str | None) -> str:
    blocks, framed, around = blocks_of(html or "")
    classify(blocks, framed, around)
    return "\n\n".join(b.text for b in blocks if b.label == "good")


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row a page: key, url, text, n_chars."""

    def rows(columns):
        for i, u, h in zip(*columns, strict=True):
            text = main_text(h)
            yield i, u, text, len(text)

    return arrow_map(pages.selectExpr(f"cast({key} as long)", url, html), rows, "page_id long, url string, text string, n_chars long", ["page_id", "url", "text", "n_chars"], [pa.int64(), pa.string(), pa.string(), pa.int64()])


def op7_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
