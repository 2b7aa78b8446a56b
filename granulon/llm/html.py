"""Main text of web pages by two passes over text blocks.

A page is cut into blocks at block-level tags. Blocks in parts that their markup names (navigation,
footers, forms, adverts, comments and so on) are decided from the start. The first pass decides the
others by link density, length and the density of stop words: good, bad, or ambiguous (short, or
nearly good). In the second pass an ambiguous block takes the label of the nearest decided blocks
before and behind it in the same part of the page; where these differ, short blocks need both to be
good and nearly good ones either. A block within an article is not bad for want of stop words alone,
and an article without any decided block is good.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granulon.llm.common import map_rows, text_of

LONG, SHORT = 200, 70
MOST_STOP, LEAST_STOP = 0.32, 0.30
MOST_LINKED = 0.2

# Frequent words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which will with you "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour que qui sa se ses son sur un une vous "
    "als am auch auf aus bei bin bis das dass dem den der des die ein eine einem einen einer er es für haben hat ich ihr im ist mit nach nicht noch oder sich sie sind so um und uns von vor war wie wir zu zum zur "
    "al como con del el ella en ese esta este fue ha hay la las lo los me mi muy no o para pero por se ser si sin sobre son su sus te un una y ya".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that hold others and whose end counts; p, li and the like end where the next block begins.
HOLDERS = frozenset("article aside body button details dialog div dl fieldset figure footer form head header html main menu nav ol section select table title ul".split())
BAD_PARTS = frozenset("aside button dialog footer form head header menu nav select title".split())
#: Parts of names by what they say: articles there are not the page's own; text there is not, however well it reads; or often just where something is.
_FOREIGN = "ads?|adverts?|advertisement|comments?|disqus|promo|promotion|recommended|related|replies|reply|sponsor|sponsored"
_FIRM = "captcha|consent|cookies?|disclaimer|footer|login|modal|newsletter|notice|notification|popup|signup|subscribe|subscription|widget"
_LAYOUT = "banner|breadcrumbs?|header|masthead|menu|nav|navbar|navigation|pager|pagination|search|share|sharing|sidebar|skip|social|tags|toolbar"
# Names of the page's layout (no-sidebar, has-header, sidebar-layout) say nothing of the element itself.
BAD_NAMES = re.compile(rf"(?:^|(?<=[\s_-]))(?<!\bno[_-])(?<!\bhas[_-])(?<!\bwith[_-])(?<!\bwithout[_-])(?:(?P<foreign>{_FOREIGN})|(?P<firm>{_FIRM})|(?P<layout>{_LAYOUT}))s?(?![_-]layout(?:$|[\s_-]))(?:$|(?=[\s_-]))", re.I)
#: How bad an element is: not, by a name of each kind, or by its tag, role or being hidden.
GOOD, LAYOUT, FIRM, FOREIGN, MARKUP = range(5)
BAD_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())

# Where a tag, a comment or a declaration begins.
_BEGIN = re.compile(r"<(?:(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)|(?P<comment>!--)|[!?/])")
_EMPTY = re.compile("-?>")  # behind <!--
#: What can end a tag, or begin a quoted value that may hold such an end.
_STOP = re.compile(r">|=\s*+([\"'])")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style")}
#: Elements without text of the page; with their content they are left out, if they end.
LEFT_OUT = frozenset("noscript template textarea iframe object svg canvas video audio annotation-xml annotation".split())
# Character references that name no character: more digits than any has; and zeros in front.
_ZEROS, _ENDLESS = re.compile(r"&#0++(?=[0-9])"), re.compile(r"&#[0-9]{8,}+;?")
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


class Block:
    __slots__ = ("text", "linked", "bad", "part", "heading", "named")

    def __init__(self, text: str, linked: int, bad: int, part: int, heading: bool, named: int):
        self.text, self.linked, self.bad, self.part, self.heading, self.named = text, linked, bad, part, heading, named


def _badness(tag: str, rest: str, within: bool) -> int:
    """How surely an element's own name or attributes say that it is no main text."""
    if tag in BAD_PARTS and not (within and tag == "header"):
        return MARKUP
    bad = GOOD
    if rest and "=" in rest or "hidden" in rest:
        for name, *values in _ATTRIBUTE.findall(rest):
            name, value = name.lower(), "".join(values)
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "role" and value.lower() in BAD_ROLES):
                return MARKUP
            if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
                for m in BAD_NAMES.finditer(value):
                    bad = max(bad, FOREIGN if m["foreign"] else FIRM if m["firm"] else LAYOUT)
    return bad


def _tokens(html: str) -> list[tuple[str, str, bool, str]]:
    """(text, tag, is an end, attributes) of texts and tags, one or the other, without comments, scripts and styles.

    Every character is looked at a bounded number of times, however broken the page. A tag without an end is
    text; one with a value whose quote never ends is taken to end at its first ">".
    """
    out: list[tuple[str, str, bool, str]] = []
    last = html.rfind(">")
    quotes = {q: html.rfind(q) for q in "\"'"}
    hopeless: set[int] = set()  # places of quoted values from which on no tag ends

    def close(at: int) -> int:
        """Where the tag ends whose name ends at `at`."""
        first, seen = at, []
        while at <= last:
            m = _STOP.search(html, at)
            if not m:
                break
            if not m[1]:
                return m.start()
            at = m.end()
            seen.append(at)
            if at in hopeless or at > quotes[m[1]]:
                break
            at = html.index(m[1], at) + 1
        hopeless.update(seen)
        return html.index(">", first)

    at = 0
    while True:
        begin = html.find("<", at)
        if begin < 0 or begin > last:
            rest = html[at:].partition("<!--")[0]
            if rest:
                out.append((rest, "", False, ""))
            return out
        if begin > at:
            out.append((html[at:begin], "", False, ""))
        m = _BEGIN.match(html, begin)
        if not m:
            out.append(("<", "", False, ""))
            at = begin + 1
        elif m["comment"]:
            empty = _EMPTY.match(html, begin + 4)
            end = html.find("-->", begin + 4)
            at = empty.end() if empty else end + 3 if end >= 0 else len(html)
        elif not m["tag"]:
            at = html.index(">", begin) + 1
        else:
            tag, end = m["tag"].lower(), close(m.end())
            rest, at = html[m.end() : end], end + 1
            if tag in _RAW_END and not m["end"]:
                over = _RAW_END[tag].search(html, at)
                at = html.index(">", over.end()) + 1 if over and over.end() <= last else len(html)
            else:
                out.append(("", tag, bool(m["end"]), rest))


def _pieces(html: str) -> Iterator[tuple[str, str, bool, str]]:
    """Texts and tags without elements that hold no text of the page; of such an element that never ends, only the tag is left out."""
    tokens = _tokens(html)
    begun: dict[str, list[int]] = {}
    ends: dict[int, int] = {}
    for i, (_, tag, end, rest) in enumerate(tokens):
        if tag in LEFT_OUT:
            if not end:
                if not (tag == "svg" and rest.endswith("/")):
                    begun.setdefault(tag, []).append(i)
            elif begun.get(tag):
                ends[begun[tag].pop()] = i
    at = 0
    while at < len(tokens):
        if tokens[at][1] not in LEFT_OUT:
            yield tokens[at]
        at = ends.get(at, at) + 1


def _unescaped(text: str) -> str:
    if "&#" in text:
        text = _ENDLESS.sub("�", _ZEROS.sub("&#", text))
    return unescape(text)


def blocks(html: str) -> list[Block]:
    """The blocks with text, in page order. Part 0 is what lies in no article."""
    out: list[Block] = []
    held: list[str] = []
    linked = parts = breaks = names = 0
    link = heading = False
    # Open holders: (tag, bad, part, number of the nearest element with a layout name); what an element says holds for all within,
    # but a name not for the page's articles.
    open_: list[tuple[str, int, int, int]] = [("", GOOD, 0, 0)]
    held_open: Counter[str] = Counter()  # how many of each are open, so that an end without a beginning costs nothing

    def flush() -> None:
        nonlocal linked, heading
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append(Block(text, linked, open_[-1][1], open_[-1][2], heading, open_[-1][3]))
            held.clear()
        linked = 0
        heading = False

    for text, tag, is_end, rest in _pieces(html):
        if text:
            if "&" in text:
                text = _unescaped(text)
            held.append(text)
            if breaks and not text.isspace():
                breaks = 0
            if link:
                linked += len(text)
        elif tag == "br":
            held.append(" ")
            breaks += 1
            if breaks > 1:
                flush()
        elif tag == "a":
            link = not is_end
        elif tag in BLOCKS:
            flush()
            link, breaks = False, 0
            if is_end:
                if held_open[tag]:
                    while True:
                        closed = open_.pop()[0]
                        held_open[closed] -= 1
                        if closed == tag:
                            break
            else:
                heading = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
                if tag == "body":
                    del open_[1:]
                    held_open.clear()
                _, bad, part, named = open_[-1]
                if tag in HOLDERS and not rest.endswith("/"):
                    if tag in ("article", "main") and not part:
                        parts += 1
                        part = parts
                    if (tag == "main" and bad < MARKUP) or (tag == "article" and bad < FOREIGN and not held_open["article"]):
                        bad = GOOD
                    own = _badness(tag, rest, part > 0)
                    if own == LAYOUT:
                        names += 1
                        named = names
                    open_.append((tag, max(bad, own), part, named))
                    held_open[tag] += 1
    flush()
    return out


def _density(text: str) -> float:
    """The share of stop words."""
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()#*$%&") in STOP_WORDS for w in words) / len(words)


def labels(found: list[Block]) -> list[bool]:
    """Whether each block is main text."""
    good: list[bool | None] = []
    near: list[bool] = []
    density = [_density(b.text) if b.bad <= LAYOUT and len(b.text) >= SHORT else 0.0 for b in found]
    # An element with a layout name is judged like others if it has a long good block without links.
    mended = {b.named for b, d in zip(found, density) if b.bad == LAYOUT and not b.linked and d >= MOST_STOP and len(b.text) > LONG}
    bad = [b.bad > LAYOUT or (b.bad == LAYOUT and b.named not in mended) for b in found]
    for b, by_markup, d in zip(found, bad, density):
        n = len(b.text)
        label: bool | None
        nearly = False
        if by_markup or b.linked > MOST_LINKED * n or (not b.part and "\xa9" in b.text):
            label = False
        elif n < SHORT:
            label = None
        elif d >= MOST_STOP and n > LONG:
            label = True
        elif d >= LEAST_STOP or b.part:
            label, nearly = None, True
        else:
            label = False
        good.append(label)
        near.append(nearly)
    # Nearest decided labels before and behind, within the same part; blocks that markup decides don't count.
    before: list[bool | None] = []
    last: dict[int, bool] = {}
    for b, g, by_markup in zip(found, good, bad):
        before.append(last.get(b.part))
        if g is not None and not by_markup:
            last[b.part] = g
    behind: list[bool | None] = []
    last = {}
    for b, g, by_markup in zip(reversed(found), reversed(good), reversed(bad)):
        behind.append(last.get(b.part))
        if g is not None and not by_markup:
            last[b.part] = g
    out = []
    for b, g, nearly, x, y in zip(found, good, near, before, reversed(behind)):
        if g is None:
            if b.part:  # in an article: only lost between bad neighbours
                g = nearly or not (x is False and y is False)
            elif nearly:
                g = x is not False or y is not False
            else:
                g = bool(x and y) or (b.heading and bool(y))
        out.append(g)
    return out


def main_text(html: str) -> str:
    found = blocks(html)
    return "\n".join(b.text for b, good in zip(found, labels(found)) if good)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each row, without a shuffle.

    Null and empty html, and pages without main text, give an empty text; repeated rows give repeated
    results; null ids and addresses are kept; an empty table gives an empty table; other columns are
    left out.
    """

    def step(c):
        texts = [main_text(h) for h in c["html"]]
        return [c["id"], c["url"], texts, [len(t) for t in texts]]

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), text_of(html_col).alias("html"))
    return map_rows(rows, lambda: step, f"{id_col} {kind}, url string, text string, n_chars bigint")
