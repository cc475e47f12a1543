"""Leaf blocks of a page: runs of text between block elements, with what stands above and in them."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache

_TAG = re.compile(r"<(?:!--|!\[CDATA\[|([!?])|(/?)([a-zA-Z][^\s/>]*))")
#: Rest of a tag; quoted values may hold a closing bracket.
_REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[a-z]+")

#: Elements whose content is not text of the page.
HIDDEN = frozenset("script style template noscript iframe object svg math canvas audio video head title select datalist".split())
#: Of these the content is not markup.
_RAW = frozenset("script style title textarea iframe noscript template".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre section summary table tbody td "
    "textarea tfoot th thead tr ul".split()
)
_CLOSED_BY_THEIR_LIKE = frozenset("p li dd dt td th tr option".split())
_HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that may stand in a head; all others and text end it.
_IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Blocks and hidden elements that may stand in a list of options; others end it.
_IN_OPTIONS = frozenset("option button div hr legend script template noscript svg".split())
#: Names that say what a part is for, by the beginnings of words in class, id and role.
HINTS = {
    "navigation": ("nav", "menu", "breadcrumb", "pagination", "toc", "skip"),
    "header": ("header", "masthead", "topbar", "logo", "site-title"),
    "footer": ("footer", "bottom", "legal", "copyright", "imprint", "contentinfo"),
    "side": ("side", "widget", "related", "recommend", "trending", "popular", "complementary"),
    "advert": ("ad", "ads", "advert", "sponsor", "promo", "banner"),
    "notice": ("cookie", "consent", "gdpr", "notice", "alert", "popup", "modal", "paywall"),
    "form": ("search", "newsletter", "login", "subscribe", "signup", "form"),
    "share": ("share", "sharing", "social"),
    "comment": ("comment", "comments", "reply", "replies", "respond", "response", "discussion", "disqus"),
    "content": ("content", "article", "post", "entry", "story", "text", "body", "main"),
}
#: Short words must match whole.
_WHOLE = frozenset(("ad", "ads", "nav", "toc", "form", "text", "body", "main", "post", "side"))


@lru_cache(maxsize=10_000)
def hints_of(name: str) -> tuple[str, ...]:
    return tuple(kind for kind, stems in HINTS.items() if any(name == s if s in _WHOLE else name.startswith(s) for s in stems))


@dataclass
class Block:
    """Text of a block, its element and that one's parent, elements and hints above it, characters in links, and a label if the page has one."""

    text: str
    tag: str
    parent: str
    around: frozenset[str]
    linked: int
    label: str | None


@dataclass
class _Open:
    """An open element; what holds for all inside it is taken over from its parent, so depth costs nothing."""

    tag: str
    inline: bool
    parent: str
    around: frozenset[str]
    label: str | None
    hidden: bool
    #: Place of the block that this is or stands in, -1 if none.
    block: int


_OUTSIDE = _Open("", False, "", frozenset(), None, False, -1)


class _Stack:
    """The open blocks and hidden elements, and where each kind of them stands."""

    def __init__(self):
        self.elements: list[_Open] = []
        self.places: defaultdict[str, list[int]] = defaultdict(list)

    @property
    def top(self) -> _Open:
        return self.elements[-1] if self.elements else _OUTSIDE

    def push(self, tag: str, names: tuple[str, ...] = (), label: str | None = None, hidden: bool = False, inline: bool = False) -> None:
        up = self.top
        own = frozenset([*([] if inline else [f"in:{tag}"]), *(f"hint:{h}" for n in names for h in hints_of(n))])
        around = up.around if own <= up.around else up.around | own
        at = len(self.elements)
        self.places[tag].append(at)
        # The parent of what stands in an inline element is that of its block.
        parent = up.parent if up.inline else up.tag
        self.elements.append(_Open(tag, inline, parent, around, up.label if label is None else label, hidden or up.hidden, up.block if inline else at))

    def cut(self, to: int) -> None:
        """End the elements from a place on."""
        while len(self.elements) > to:
            self.places[self.elements.pop().tag].pop()

    def close(self, tag: str) -> None:
        if self.places[tag]:
            self.cut(self.places[tag][-1])

    def block(self) -> int:
        """Place of the last open block, -1 if none."""
        return self.top.block

    def block_above(self, at: int) -> int:
        """Place of the block that the element at a place stands in, -1 if none."""
        return self.elements[at - 1].block if at > 0 else -1


def _names(attributes: str) -> tuple[tuple[str, ...], str | None, bool]:
    names, label, hidden = [], None, False
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key in ("class", "id", "role"):
            names += _NAME.findall(value.lower())
        elif key == "data-label":
            label = value
        elif key == "hidden" or (key == "style" and "display:none" in value.replace(" ", "").lower()):
            hidden = True
    return tuple(names), label, hidden


def leaf_blocks(page: str | None) -> list[Block]:
    """Blocks of a page in order; markup that is not closed counts to the end of what holds it.

    Comments, hidden elements and elements without page text are left out. A line break is white
    space. Each run of white space becomes one space. A head ends at the first element or text that
    may not stand in it, a list of options at a block that may not. A hidden element that the rest of
    the page does not close ends with what holds it, or at the next block; script, style, template,
    noscript, iframe and title hold no markup and, unclosed, the rest of the page, as in browsers. An
    inline element that is hidden ends with its own end tag, elements of its kind inside it counted,
    or with what holds it. Time and memory are linear in the page however deep its elements nest.
    """
    page = page or ""
    blocks: list[Block] = []
    stack = _Stack()
    parts: list[str] = []
    linked, link = 0, False

    def flush() -> None:
        nonlocal linked, link
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            top = stack.top
            tag, parent = (stack.elements[at].tag, stack.elements[at].parent) if top.inline and (at := stack.block()) >= 0 else (top.tag, top.parent)
            blocks.append(Block(text, tag, parent, top.around, min(linked, len(text)), top.label))
        parts.clear()
        linked, link = 0, False

    last: dict[str, int] = {}

    def is_closed(tag: str, at: int) -> bool:
        """Whether an end tag of the element stands behind a place."""
        if tag not in last:
            last[tag] = max((x.start() for x in re.finditer(rf"</{tag}[\s/>]", page, re.I)), default=-1)
        return last[tag] >= at

    def leave(tag: str, at: int) -> None:
        """End the open hidden elements that an element which begins here shows to be over."""
        over = []
        for kind in HIDDEN:
            if not stack.places.get(kind):
                continue
            if kind == "head":
                ends = tag not in _IN_HEAD
            elif kind in ("select", "datalist"):
                ends = tag in BLOCKS | HIDDEN and (tag not in _IN_OPTIONS or tag in ("div", "button") and not is_closed(kind, at))
            else:
                ends = tag in BLOCKS and not is_closed(kind, at)
            if ends:
                over.append(stack.places[kind][0])
        if over:
            flush()
            stack.cut(min(over))

    at, end = 0, len(page)
    while at < end:
        found = _TAG.search(page, at)
        to = found.start() if found else end
        if to > at:
            if stack.top.tag == "head" and not page[at:to].isspace():
                leave("", at)
            if not stack.top.hidden:
                parts.append(page[at:to])
                linked += (to - at) * link
        if not found:
            break
        token = found[0]
        if token == "<!--":
            stop = page.find("-->", found.end() - 2)
            at = stop + 3 if stop >= 0 else end
            continue
        if token == "<![CDATA[":
            stop = page.find("]]>", found.end())
            at = stop + 3 if stop >= 0 else end
            continue
        rest = _REST.match(page, found.end())
        if rest:
            inner, at = rest[0], rest.end()
        else:  # a quote that is not closed
            stop = page.find(">", found.end())
            inner, at = page[found.end() : stop], stop + 1 if stop >= 0 else end
        if found[1]:
            continue
        tag = found[3].lower()
        if found[2]:
            if tag in ("body", "html"):
                leave(tag, at)
            if tag in BLOCKS or tag in HIDDEN:
                flush()
                stack.close(tag)
            else:
                if tag == "a":
                    link = False
                if stack.places.get(tag):
                    stack.close(tag)
            continue
        leave(tag, found.start())
        if tag not in BLOCKS and tag not in HIDDEN:
            hidden = ("hidden" in inner or "display" in inner) and _names(inner)[2]
            if tag == "br" and not stack.top.hidden:
                parts.append(" ")
            # Kept on the stack where hidden, and inside one of its kind, whose end tag is then not the next one.
            if tag not in _VOID and not inner.endswith("/>") and (hidden or stack.places.get(tag)):
                stack.push(tag, hidden=hidden, inline=True)
            if tag == "a" and not hidden:
                link = True
            continue
        flush()
        if tag in _VOID:
            continue
        if tag in _RAW and tag in HIDDEN:
            stop = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            at = stop.start() if stop else end
            continue
        if tag in _CLOSED_BY_THEIR_LIKE:
            own = stack.block()
            above = stack.block_above(own)
            near = [stack.elements[x].tag for x in (above, own) if x >= 0]
            if near and near[-1] == tag or tag != "p" and tag in near:
                stack.close(tag)
        own = stack.block()
        if own >= 0 and stack.elements[own].tag == "p":
            stack.cut(own)  # a block ends a paragraph
            own = stack.block()
        if tag in _HEADS and own >= 0 and stack.elements[own].tag in _HEADS:
            stack.cut(own)
        names, label, hidden = _names(inner)
        stack.push(tag, names, label, hidden or tag in HIDDEN)
    flush()
    return blocks
