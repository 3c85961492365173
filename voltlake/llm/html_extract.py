"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags; what stands in menus, page headers and footers, sidebars, forms, scripts
and styles (by tag or role) and what is hidden is left out.  The first pass decides each block by its length, its
density of stop words and its density of links; short blocks and headings stay open.  In the second pass these take
the label of the nearest decided neighbours.  Where the page as a whole has few stop words (another language or script,
terse prose) they say nothing, and length and links alone decide.

Classes and ids that name advertisements, notices, comments and the like are evidence: their blocks are left out as
long as other text remains.  A name counts only if all its parts are such words or mean a place ("ad-box", not
"category-privacy"), and never on an article or main element.  Such elements are evidence too: blocks outside are left
out where they hold a fair share of the page's text, and inside a long block needs no stop words; a page with a mere
teaser in one is judged by its blocks.

An inline element, open or closed, ends no block: words around it stay one sentence.  A form outside an article is left
out unless it holds most of the page's prose (some pages are one form); one in an article always is.  An article or main
element that begins inside an open nav, form or fieldset shows that these weren't meant to hold it.  Inside an article
a single block that is one link has no say of its own: its neighbours decide.

Defined results: null or empty html has the empty text; broken markup is read as far as it goes (an unclosed tag or
comment ends with the page); repeated rows are read each; a very long or deep page is one row, read in one pass; an
empty table gives an empty result; other columns pass through unread.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltlake.llm.common import give_back

#: Limits of the rules: link density, length of a short and of a long block, stop-word density from low and from high, share of the text outside that articles need.
LINKS, SHORT, LONG, STOP_LOW, STOP_HIGH, ARTICLES = 0.4, 70, 200, 0.15, 0.3, 1 / 3
#: How many times the prose outside forms that inside must be for the page to be one form.
FORMS = 2
#: Fixed stop words of the four languages.
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you were there been their has "
    "de la le et les des en un du une que est pour qui dans par plus pas sur ne se avec ce il au son cette mais ou nous vous je "
    "der die und das von zu mit sich auf für ist im dem nicht ein eine als auch es werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über "
    "el los y del las por con no para su al lo como más o pero sus ha me si sin sobre este ya entre cuando todo esta ser son dos".split()
)
#: Tags that end a block; tags whose content is never article text; text between raw tags isn't markup.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
LEFT_OUT = frozenset("nav footer aside form head title script style noscript template iframe svg canvas audio video object select button textarea dialog menu applet map fieldset".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
#: Tags left out that an article or main element inside them overrules.
OVERRULED = {"article": frozenset("nav form fieldset".split()), "main": frozenset("nav form fieldset aside header".split())}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of a class or id, and roles, that mark what isn't article text.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot banner sponsor sponsored sponsors promo promoted promotion sidebar sidebars aside rail nav navbar navigation menu menus submenu breadcrumb breadcrumbs crumbs "
    "footer foot colophon masthead topbar header cookie cookies consent gdpr privacy notice notices notification alert popup popover overlay modal newsletter subscribe subscription signup login paywall comment comments commentlist disqus reply replies respond "
    "discussion social share sharing sharebar related recommended recommendations trending popular widget widgets toolbar pagination pager copyright legal disclaimer skip hidden offscreen search".split()
)
#: Words of a class or id that say where or how something stands, not what it is.
PLACES = frozenset("area bar bottom box btn button buttons block bottom center col column container content full global group inline inner item items left li link links list main middle outer page panel post posts primary right row secondary section sections site slot small sub text top unit wrap wrapper x".split())
#: Marks that only lay out the page when they stand inside an article.
LAYOUT = frozenset("header banner masthead topbar rail".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)", re.S)
_QUOTE_OR_END = re.compile("[\"'>]")
#: One attribute: its whole name, then its value, which may hold anything.
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s>"'][^\s>]*+))?)?""")
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[^\W\d_]+")
#: Characters that each stand for about a third of a word or more: they count double.
_WIDE = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _named(value: str, inside: bool) -> bool:
    """Whether a name of a class or id says that it isn't article text.  inside: in an article."""
    for name in value.split():
        parts = {x.lower() for x in _NAME_PARTS.findall(name)}
        if inside:
            parts -= LAYOUT
        if not parts.isdisjoint(MARKS) and parts <= MARKS | PLACES:
            return True
    return False


def _marked(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element's attributes leave it out (hidden, or of another role), and whether its names are evidence against it."""
    out = named = False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        out = out or bool(name == "role" and value.lower() in ROLES or name == "aria-hidden" and value.lower() == "true" or name == "hidden" or name == "style" and _HIDES.search(value))
        named = named or name in ("class", "id") and tag not in ("html", "body", "main", "article") and _named(value, inside)
    return out, named


class Block:
    """A block's text and what the rules need of it: length (wide characters count double), linked characters, words, stop words."""

    __slots__ = ("form", "heading", "inside", "links", "named", "size", "stops", "text", "words")

    def __init__(self, text: str, links: int, heading: bool, inside: bool, named: bool, form: bool = False):
        self.text, self.links, self.heading, self.inside, self.named, self.form = text, links, heading, inside, named, form
        words = _WORD.findall(text.lower())
        self.size, self.words, self.stops = len(text) + len(_WIDE.findall(text)), len(words), sum(w in STOP_WORDS for w in words)


class Tags:
    """Where tags end: at the first > outside quotes, or where a quote is never closed at the first > of all.

    What a failed search has passed is remembered, so that a later one that comes upon it stops there.
    """

    def __init__(self, html: str):
        self.html, self.failed = html, set()

    def end(self, at: int) -> tuple[str, int]:
        """The attributes of a tag whose name ends at ``at``, and where reading goes on."""
        passed, p = [], at
        while True:
            m = _QUOTE_OR_END.search(self.html, p)
            if not m:
                return self.html[at:], len(self.html)
            if m[0] == ">":
                return self.html[at : m.start()], m.end()
            p = self.html.find(m[0], m.end()) + 1
            if not p or p in self.failed:
                break
            passed.append(p)
        self.failed.update(passed)
        close = self.html.find(">", at)
        return (self.html[at:], len(self.html)) if close < 0 else (self.html[at:close], close + 1)


def blocks_of(html: str) -> list[Block]:
    out: list[Block] = []
    parts: list[str] = []
    linked = at = 0
    # open elements, each with what it adds to the counters (left out, link, heading, article, named, form), and the places of block-level ones
    stack: list[tuple[str, tuple[int, ...]]] = []
    block_at: list[int] = []
    open_tags: Counter[str] = Counter()
    lefts = links = headings = articles = names = forms = 0
    tags, overruled = Tags(html), []  # places of open elements that an article may overrule

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, linked, headings > 0, articles > 0, names > 0, forms > 0))
            parts.clear()
        linked = 0

    def count(adds: tuple[int, ...], sign: int) -> None:
        nonlocal lefts, links, headings, articles, names, forms
        lefts, links, headings, articles, names, forms = (x + sign * y for x, y in zip((lefts, links, headings, articles, names, forms), adds, strict=True))

    def shut(k: int) -> None:
        for tag, adds in stack[k:]:
            count(adds, -1)
            open_tags[tag] -= 1
        del stack[k:]
        while block_at and block_at[-1] >= k:
            block_at.pop()
        while overruled and overruled[-1] >= k:
            overruled.pop()

    def overrule(tag: str) -> None:
        """Elements that can't have been meant to hold this one neither leave it out nor count as forms."""
        for k in [k for k in overruled if stack[k][0] in OVERRULED[tag]]:
            name, adds = stack[k]
            count((adds[0], 0, 0, 0, 0, adds[5]), -1)
            stack[k] = name, (0, *adds[1:5], 0)
            overruled.remove(k)

    def words(text: str) -> None:
        nonlocal linked
        if text and not lefts:
            text = unescape(text)
            parts.append(text)
            if links:
                linked += len(text.strip())

    while m := _MARKUP.search(html, at):
        words(html[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                words(m[0][9:].removesuffix("]]>"))
            continue
        tag, closing = m[2].lower(), bool(m[1])
        attributes, at = tags.end(at)
        if tag == "br":
            words(" ")
            continue
        if tag in BLOCKS:
            flush()
        if closing:
            if open_tags[tag]:  # what is looked at here is closed here
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                if block_at and block_at[-1] >= k:
                    flush()
                shut(k)
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b", re.I).search(html, at)
            at = html.find(">", end.end()) + 1 or len(html) if end else len(html)
            continue
        block = tag in BLOCKS
        if tag in VOID or attributes.endswith("/") and not block:
            continue
        if block and block_at:  # a paragraph or item ends where the next block begins
            last = stack[block_at[-1]][0]
            if last == "p" or last == tag and tag in ("li", "dt", "dd", "option", "tr", "td", "th") or last in HEADINGS and tag in HEADINGS:
                shut(block_at[-1])
        if tag in OVERRULED and overruled:
            overrule(tag)
        hidden, named = _marked(tag, attributes, articles > 0)
        form = tag in ("form", "fieldset") and not articles and not hidden
        left = tag in LEFT_OUT and not form or tag == "header" and not articles or hidden or named and not block
        if block:
            block_at.append(len(stack))
        if left and not hidden and tag in ("nav", "aside", "header") or form:
            overruled.append(len(stack))
        stack.append((tag, (int(left), int(tag == "a"), int(tag in HEADINGS), int(tag in ("article", "main")), int(named), int(form))))
        open_tags[tag] += 1
        count(stack[-1][1], 1)
    words(html[at:])
    flush()
    return out


def first_pass(b: Block, told: bool) -> str:
    """good, near, bad, or short (open).  told: the page's stop words say something."""
    if b.links and b.links / len(b.text) > LINKS:
        return "bad"
    if b.heading or b.size < SHORT:
        return "bad" if b.links and not b.inside else "short"
    stop = b.stops / max(b.words, 1)
    if stop >= STOP_HIGH or not told:
        return "good" if b.size > LONG else "near"
    return "near" if stop >= STOP_LOW or b.inside else "bad"


def second_pass(blocks: list[Block], labels: list[str]) -> list[bool]:
    """Open blocks take the label of the nearest decided neighbour; of two as near, good wins in an article.  Near ones count as decided, good unless both their neighbours are bad."""
    n = len(blocks)
    near_before, near_after = [-1] * n, [n] * n
    for k in range(1, n):
        near_before[k] = k - 1 if labels[k - 1] != "short" else near_before[k - 1]
    for k in range(n - 2, -1, -1):
        near_after[k] = k + 1 if labels[k + 1] != "short" else near_after[k + 1]
    keep = []
    for k, b in enumerate(blocks):
        sides = [j for j in (near_before[k], near_after[k]) if 0 <= j < n]
        if labels[k] in ("good", "bad"):
            keep.append(labels[k] == "good")
        elif labels[k] == "near":
            keep.append(not (len(sides) == 2 and all(labels[j] == "bad" for j in sides)))
        elif not sides:
            keep.append(b.inside)
        else:
            least = min(abs(j - k) for j in sides)
            nearest = [labels[j] != "bad" for j in sides if abs(j - k) == least]
            keep.append(any(nearest) if b.inside else all(nearest))
    return keep


def _article(blocks: list[Block]) -> list[str]:
    """The texts of the blocks that both passes keep, of the region that holds the article."""
    told = sum(b.stops for b in blocks) >= STOP_LOW * sum(b.words for b in blocks)
    labels = [first_pass(b, told) for b in blocks]
    dense = [False, *(b.links > LINKS * len(b.text) for b in blocks), False]
    labels = ["short" if b.inside and dense[k + 1] and not dense[k] and not dense[k + 2] else label for k, (b, label) in enumerate(zip(blocks, labels, strict=True))]
    inside = sum(b.size for b, label in zip(blocks, labels, strict=True) if b.inside and label != "bad")
    outside = sum(b.size for b, label in zip(blocks, labels, strict=True) if not b.inside and label in ("good", "near"))
    if inside and inside >= ARTICLES * outside:
        pairs = [(b, label) for b, label in zip(blocks, labels, strict=True) if b.inside]
        blocks, labels = [b for b, _ in pairs], [label for _, label in pairs]
    else:
        blocks = [b for b, label in zip(blocks, labels, strict=True) if not (b.inside and label == "short")]  # a teaser's
        for b in blocks:
            b.inside = False
        labels = [first_pass(b, told) for b in blocks]
    return [b.text for b, good in zip(blocks, second_pass(blocks, labels), strict=True) if good]


def main_text(html: str) -> str:
    blocks = blocks_of(html)
    prose = [sum(b.size for b in blocks if b.form == form and b.size >= SHORT and b.links <= LINKS * len(b.text)) for form in (False, True)]
    if prose[1] <= FORMS * prose[0]:
        blocks = [b for b in blocks if not b.form]
    return "\n".join(_article([b for b in blocks if not b.named]) or _article(blocks))


@F.pandas_udf(T.StringType())
def extracted(html: pd.Series) -> pd.Series:
    found = [main_text(h) for h in html]
    give_back()
    return pd.Series(found, dtype=object)


def extract_pages(pages: DataFrame, *keep: str | Column) -> DataFrame:
    """pages -> keep (page_id and url by default), text, n_chars for each row."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(*(keep or ("page_id", "url")), extracted(html).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
