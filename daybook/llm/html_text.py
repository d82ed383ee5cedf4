"""Main text of web pages by tag-path ratios.

A page is read into blocks of text, each with its path of tags from the root.
Per path, text length and punctuation are aggregated and divided by the path's
number of blocks; the two ratios are smoothed along the page, the more the closer
two paths are, fused, and thresholded, which tells paths of running text from
those of links and labels; a path of whole sentences is running text however long
the others are. The content node is the lowest element that holds all selected
blocks, on pages with an article or main element too; where it lies inside such
elements, the outermost one. Its blocks are the result, but for containers
that hold no selected block: these are scored as something else, unless they lie
in the deepest element that holds most of the selected text, or in an article that
holds most of it or is mostly selected. A heading belongs to the block behind it,
also right before the content node.

Parts that are named as something else than the article (navigation, footers,
forms, scripts, adverts, notices, sidebars, reader comments, by tag, role,
class or id) don't count. A class or id names such a part only if all words of one
of its tokens do, so topics ("category-social", "related-work") don't; it never hides
html, body, main and article elements (but a reader's comment, an article in one of the last two that is called so), nor what holds most of a page's text in several
paragraphs, if nothing else on the page reads like sentences. The id of a heading or an inline element, and inside
an article that of a section, is an anchor and names nothing. The text of math
and xmp elements is text. A quoted attribute ends at its closing quote, however long
it is; behind a quote that never closes, tags end at the next ``>``. Character references are decoded, white space inside
a block is one space, blocks are joined by line feeds in page order; a ``br`` is
white space.

Null, empty and textless pages give "". Unclosed and stray tags are tolerated,
elements nested beyond ``DEPTH`` count as children of the last one above it, and
cost is linear in the page. Rows keep
their multiplicity.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPTH = 200
#: An element with more than this share of the selected text keeps all of its blocks.
MOST = 0.5
#: Paragraphs that a part named as something else must have to be content all the same.
SEVERAL = 3
#: Selected paths score at least this part of the page's mean over characters.
CUT = 0.25
#: No path needs a score above this one: 80 characters and two marks, about a sentence or two a block.
SENTENCES = 80 * float(np.log1p(1.0 + 2.0))

# Element names and words of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes noscript template svg".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output picture "
    "progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle "
    "msub msubsup msup mtable mtd mtext mtr munder munderover none semantics annotation annotation-xml".split()
)
#: Inline elements that stand apart from what is before them.
APART = frozenset("mtr mtd annotation annotation-xml".split())
NEVER = frozenset("head nav footer aside form button select option datalist dialog menu script style noscript template".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hr li main menu nav ol p pre section table ul".split()
)
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption table thead tbody tfoot tr hr address details summary xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MARKED = frozenset(("article", "main"))
SIBLINGS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "p": {"td", "th", "li", "div", "article", "section", "main", "body"}}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
LAYOUT = frozenset(
    "nav navbar navigation menu topnav subnav breadcrumb breadcrumbs header masthead topbar footer bottombar sidebar sidebars aside widget "
    "widgets toc pagination pager toolbar".split()
)
OTHERS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot banner sponsor sponsored promo promotion cookie cookies "
    "consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup login "
    "search share sharing social comment comments disqus respond replies discussion related recommended recommendations skip".split()
)
#: What a class token may hold beside words of LAYOUT and OTHERS and still be a name of such a part.
HELPERS = frozenset(
    "a area bar block body box btn button buttons container content count form group head heading icon icons inner item items link links list "
    "main message more my notice outer panel popular post posts reader readers row section site slot text thread title top unit user users "
    "wrap wrapper".split()
)

# A quoted value runs to its closing quote, however long it is.
_TAG = re.compile(
    r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*>?|(/?)([a-zA-Z][^\s/>]{0,80}+)([^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+)>)""", re.S
)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]{0,80}+)([^>]*+)>")
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_XMP = re.compile(r"</xmp\b[^>]*>?", re.I)
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PUNCTUATION = re.compile(r"[.,;:!?、。！？；：，]")


class Node:
    __slots__ = ("tag", "parent", "path", "never", "marked", "depth", "size", "chars", "soft")

    def __init__(self, tag: str, parent: Node | None, never: bool, mark: str = "", soft: int | None = None) -> None:
        self.tag, self.parent, self.never, self.soft = tag, parent, never, soft
        self.marked = bool(parent and parent.marked) or tag in MARKED
        while parent and parent.depth >= DEPTH:
            self.parent = parent = parent.parent
        self.depth = parent.depth + 1 if parent else 0
        self.path = "" if not parent else f"{parent.path}/{tag}{mark}" if self.depth < DEPTH else f"{parent.path}/*"
        self.size = self.chars = 0.0


NAMES = LAYOUT | OTHERS | HELPERS
#: What an article inside an article or main element is called that holds a reader's comment.
COMMENTS = frozenset("comment comments replies respond".split())
#: Elements whose class or id never hides them, but for such comments.
WHOLE = frozenset(("html", "body", "main", "article"))


def _named(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool, bool, str]:
    """If the element is hidden or has a role outside the article, if its names say so, if they only say its place in the layout, and its first class."""
    if not attributes.strip():
        return False, False, False, ""
    never = named = layout = False
    mark = ""
    anchor = tag in HEADINGS or tag in INLINE or in_article and tag == "section"
    for m in _ATTR.finditer(attributes):
        name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if name in ("class", "id"):
            if name == "class" and value.split():
                mark = "." + value.split()[0]
            if tag == "article" and in_article:
                words = [set(_WORDS.findall(_CAMEL.sub("-", token).lower())) for token in value.split()]
                named |= any(w <= NAMES and w & COMMENTS for w in words)
            if tag not in WHOLE and not (anchor and name == "id"):
                for token in value.split():
                    # A topic ("category-social", "related-work") names no part of the page.
                    found = set(_WORDS.findall(_CAMEL.sub("-", token).lower()))
                    if found <= NAMES:
                        named |= bool(found & OTHERS)
                        layout |= bool(found & LAYOUT)
        elif name == "role":
            never |= value.strip().lower() in ROLES
        elif name == "hidden":
            never |= value.lower() != "until-found"
        elif name == "aria-hidden":
            never |= value.strip().lower() == "true"
        else:
            never |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
    return never, named, layout, mark


def blocks(page: str, spared: frozenset[int] = frozenset()) -> tuple[list[tuple[Node, str]], Counter[int]]:
    """The blocks of a page that may be content, in order, with their innermost block element.

    Also, by place in the page, the elements that only their class or id hides, with the characters in them; ``spared`` are
    the places of elements that it doesn't hide.
    """
    soft: Counter[int] = Counter()
    root = Node("", None, False)
    stack, out, parts = [root], [], []
    unclosed: Counter[str] = Counter()  # elements of the stack by tag
    size, at, last, wrappers, broken = len(page), 0, page.rfind(">"), False, False

    def owner() -> Node:
        return next(n for n in reversed(stack) if n.tag not in INLINE)

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            node = owner()
            if text and not node.never:
                out.append((node, text))

    def push(node: Node) -> None:
        stack.append(node)
        unclosed[node.tag] += 1

    def pop(size: int) -> None:
        unclosed.subtract(n.tag for n in stack[size:])
        del stack[size:]

    def close(tags: set[str], scope: set[str]) -> None:
        """Close the nearest element of ``tags``, unless an element of ``scope`` lies between."""
        if any(unclosed[t] > 0 for t in tags):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in tags:
                    pop(k)
                    return
                if stack[k].tag in scope:
                    return

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        if lt > at and not stack[-1].never:
            parts.append(page[at:lt])
        elif stack[-1].soft is not None:
            soft[stack[-1].soft] += lt - at
        if lt == size:
            break
        m = None
        if lt < last:
            m = None if broken else _TAG.match(page, lt)
            if not m and (m := _LOOSE.match(page, lt)):
                # A quote is open to the end of the page: from here on, a tag ends at the next >, so no tag is scanned to the end again.
                broken = True
        if not m:
            after = page[lt + 1 : lt + 3].lstrip("/")[:1]
            if lt > last and (after.isalpha() or after in ("!", "?")):
                break  # the page ends inside a tag or comment
            if not stack[-1].never:
                parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if unclosed[tag] > 0:
                k = next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag)
                if tag not in INLINE or any(n.tag not in INLINE for n in stack[k + 1 :]):
                    flush()
                pop(k)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
                at = end.end() if end else size
            continue
        if tag not in INLINE:
            flush()
        if tag in CLOSES_P:
            close({"p"}, SCOPES["p"])
        if tag in SIBLINGS:
            close(SIBLINGS[tag], SCOPES[tag])
        parent = stack[-1]
        in_article = parent.marked
        never, named, layout, mark = _named(tag, m[3], in_article)
        named = named and lt not in spared
        if tag in MARKED and not never and not in_article and wrappers:
            # A layout word on a wrapper of the article speaks of the page, not of the article.
            for n in reversed(stack):
                if n.never is False:
                    break
                n.never = n.never is True
            wrappers = False
        never = never or tag in NEVER or (tag == "header" and not in_article)
        inside = parent.soft if parent.never is True else None
        soft_at = None if never or parent.never is True and inside is None else inside if inside is not None else lt if named else None
        never = never or named or parent.never is True
        if tag in INLINE:
            # Inline elements only count where they hide their text, and inside such ones, as their end tags close them alone.
            if never and (parent.never is not True or unclosed[tag] > 0):
                push(Node(tag, parent, True, soft=soft_at))
            elif tag in APART and not never:
                parts.append(" ")
            continue
        state = True if never else "layout" if (layout and not in_article) or parent.never == "layout" else layout
        wrappers = wrappers or state == "layout"
        push(Node(tag, parent, state, mark, soft_at))
        if tag == "xmp":
            # Its content is text up to its end tag.
            end = _XMP.search(page, at)
            if state is not True:
                parts.append(page[at : end.start() if end else size].replace("&", "&amp;"))
            flush()
            pop(len(stack) - 1)
            at = end.end() if end else size
    flush()
    return [(n, t) for n, t in out if not n.never], soft


_KERNEL = np.exp(-0.5 * np.arange(-2, 3) ** 2)
_KERNEL /= _KERNEL.sum()


def _alike(one: str, two: str) -> float:
    """1 for paths with the same parent, a quarter for every step that they are further apart."""
    if one == two:
        return 1.0
    a, b = one.split("/"), two.split("/")
    common = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return 0.25 ** max(0, len(a) + len(b) - 2 * common - 2)


def path_scores(found: list[tuple[Node, str]]) -> np.ndarray:
    """The fused ratio of each block: smoothed text length and punctuation per path.

    Smoothing is Gaussian along the page, each neighbour by the likeness of its
    path, so that a label beside the text gains little from it and a heading in
    the text much; what a neighbour doesn't get stays with the block itself.
    """
    numbers: dict[str, int] = {}
    at = np.array([numbers.setdefault(node.path, len(numbers)) for node, _ in found])
    paths, blocks_of = list(numbers), np.bincount(at)
    length = (np.bincount(at, weights=[len(t) for _, t in found]) / blocks_of)[at]
    points = (np.bincount(at, weights=[len(_PUNCTUATION.findall(t)) for _, t in found]) / blocks_of)[at]
    more_length, more_points = np.zeros(len(at)), np.zeros(len(at))
    known: dict[tuple[int, int], float] = {}
    for step in (1, 2):
        pairs = list(zip(at[:-step].tolist(), at[step:].tolist(), strict=True))
        for pair in set(pairs) - known.keys():
            known[pair] = _alike(paths[pair[0]], paths[pair[1]])
        weight = _KERNEL[2 + step] * np.array([known[p] for p in pairs])
        for values, more in ((length, more_length), (points, more_points)):
            change = weight * (values[step:] - values[:-step])
            more[:-step] += change
            more[step:] -= change
    return (length + more_length) * np.log1p(1.0 + points + more_points)


def _most(soft: Counter[int], found: list[tuple[Node, str]]) -> frozenset[int]:
    whole = sum(len(t) for _, t in found) + sum(soft.values())
    return frozenset(at for at, n in soft.items() if n > MOST * whole)


def main_text(page: str | None) -> str:
    found, soft = blocks(page or "")
    # Where nothing else reads like sentences, several paragraphs that do and hold most of a page's text are its content, whatever they are called.
    spared: frozenset[int] = frozenset()
    while (most := _most(soft, found)) and (not found or path_scores(found).max() < SENTENCES):
        spared |= most
        more, soft = blocks(page or "", spared)
        if more and (path_scores(more) >= SENTENCES).sum() >= SEVERAL:
            found = more
    if not found:
        return ""
    sizes = np.array([len(t) for _, t in found], dtype=float)
    scores = path_scores(found)
    chosen = scores >= min(SENTENCES, CUT * float((scores * sizes).sum() / sizes.sum()))
    total = float(sizes[chosen].sum())
    for (node, _), size, c in zip(found, sizes, chosen, strict=True):
        n: Node | None = node
        while n is not None:
            n.size += size
            n.chars += size * c
            n = n.parent
    # Sizes are whole numbers, so that sums are exact. From any selected block upwards: the first that holds all.
    best = found[int(np.argmax(chosen))][0]
    while best.chars < total or best.tag in TEXT:
        best = best.parent
    n = best
    while n is not None:
        best, n = n if n.tag in MARKED else best, n.parent
    core = best
    for (node, _), c in zip(found, chosen, strict=True):
        if c:
            deep = next(n for n in _up(node) if n.tag not in TEXT and n.chars > MOST * total)
            core = deep if deep.depth > core.depth else core
    whole = lambda n: n is core or n.tag == "article" and n.chars > MOST * min(n.size, total)
    keep = [bool(c) or _has(n, best) and (_container(n).chars > 0 or any(map(whole, _up(n)))) for (n, _), c in zip(found, chosen, strict=True)]
    for i in range(len(found) - 2, -1, -1):
        keep[i] = keep[i] or keep[i + 1] and found[i][0].tag in HEADINGS and (_has(found[i][0], best) or found[i][0].tag == "h1")
    # Right before the content node: from the nearest heading on, what stands in an element around the node.
    around, first = {id(n) for n in _up(best)}, keep.index(True)
    start = first
    for k in range(first - 1, -1, -1):
        node = found[k][0]
        if id(_container(node)) not in around or not (node.tag in HEADINGS or node.tag == "p" or id(node) in around):
            break
        if node.tag in HEADINGS:
            start = k
        elif start < first:
            break
    keep[start:first] = [True] * (first - start)
    return "\n".join(t for (_, t), k in zip(found, keep, strict=True) if k)


def _up(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def _container(node: Node) -> Node:
    """The innermost element around a block that isn't itself text."""
    return next(n for n in _up(node) if n.tag not in TEXT)


def _has(node: Node | None, ancestor: Node | None) -> bool:
    while node is not None:
        if node is ancestor:
            return True
        node = node.parent
    return False


def extract(pages: DataFrame, carry: list[str], page: str = "html", name: str = "text") -> DataFrame:
    """The carried columns and the main text of every row."""

    @F.pandas_udf("string")
    def read(found: pd.Series) -> pd.Series:
        return pd.Series([main_text(p) for p in found], dtype=object)

    return pages.select(F.struct(*carry).alias("row"), read(F.col(page)).alias("_text")).select("row.*", F.col("_text").alias(name))
