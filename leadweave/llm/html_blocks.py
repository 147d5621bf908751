"""Leaf text blocks of an HTML page, in page order, with what stands around them.

A page costs its length, however deep it nests: blocks share the elements around them as linked places, open elements are counted by name, and an
element without an end tag is searched for its end once. The tags and names that a place sums up are those of its outermost ``DEPTH``
elements; texts, and paths asked for, are whole.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>?|[^<]+|<", re.DOTALL)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_NAME_PARTS = re.compile(r"[a-z]+")
# Elements whose content is not text of the page, and those that do not break a block.
UNREAD = frozenset("script style noscript template svg math iframe object canvas title textarea select option".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
# An option ends at the next tag, or at its own end tag if there are only inline ones before it.
_TEXT = r"(?:[^<]|<(?![a-zA-Z/!?]))*"
_OPTION = re.compile(rf"{_TEXT}(?:(?:</?(?:{'|'.join(sorted(INLINE))})(?=[\s/>])[^>]*>{_TEXT})*</option(?=[\s/>])[^>]*>?)?", re.IGNORECASE)
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_UNQUOTED_END = re.compile(r"=\s*(?![\s\"'])\S*\Z")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that an opening tag of the same group ends.
CLOSED_BY_NEXT = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())


DEPTH = 512


class Place:
    """An open element and those around it."""

    __slots__ = ("parent", "tag", "own_names", "depth", "tags", "name_set")

    def __init__(self, parent: Place | None, tag: str, own_names: tuple[str, ...]):
        self.parent, self.tag, self.own_names = parent, tag, own_names
        self.depth = parent.depth + 1 if parent else 0
        around = (parent.tags, parent.name_set) if parent else (frozenset(), frozenset())
        if not parent or self.depth > DEPTH:
            self.tags, self.name_set = around
        else:  # shared with the parent where it adds nothing
            self.tags = around[0] if tag in around[0] else around[0] | {tag}
            self.name_set = around[1] if around[1].issuperset(own_names) else around[1].union(own_names)


class Block:
    """``text``: references decoded, white space runs as one space; ``link_chars``: its code points within links; ``place``: the innermost element."""

    __slots__ = ("text", "place", "link_chars")

    def __init__(self, text: str, place: Place, link_chars: int):
        self.text, self.place, self.link_chars = text, place, link_chars

    def _around(self) -> list[Place]:
        out, at = [], self.place
        while at.parent:
            out.append(at)
            at = at.parent
        return out[::-1]

    @property
    def path(self) -> tuple[str, ...]:
        """Names of the elements around the block, outermost first."""
        return tuple(p.tag for p in self._around())

    @property
    def names(self) -> tuple[str, ...]:
        """Lower-case parts of their class, id and role values."""
        return tuple(n for p in self._around() for n in p.own_names)


def _empty(attributes: str) -> bool:
    """Whether a tag ends itself: with a slash that is not part of an unquoted value."""
    return attributes.endswith("/") and not _UNQUOTED_END.search(_QUOTED.sub('""', attributes))


def blocks(html: str | None) -> list[Block]:
    """Blocks that have text. An end tag closes up to the nearest element of its name; one without such an element is ignored."""
    html = html or ""
    found: list[Block] = []
    path = [Place(None, "", ())]
    opened: Counter[str] = Counter()
    endless: set[str] = set()  # elements that have no end tag from here on
    parts: list[str] = []
    linked: list[str] = []
    in_link, at = False, 0

    def flush() -> None:
        text = " ".join(unescape("".join(parts)).split())
        if text:
            found.append(Block(text, path[-1], len(" ".join(unescape(" ".join(linked)).split()))))
        parts.clear()
        linked.clear()

    def close() -> None:
        flush()
        opened[path.pop().tag] -= 1

    while at < len(html):
        token = _MARKUP.match(html, at)
        at = token.end()
        closing, name = token.group(1), token.group(2)
        if name is None:
            if not token.group().startswith(("<!", "<?")):
                parts.append(token.group())
                if in_link:
                    linked.append(token.group())
            continue
        name = name.lower()
        if closing:
            if name == "a":
                in_link = False
            elif name not in INLINE and opened[name] > 0:
                while path[-1].tag != name:
                    close()
                close()
            elif name == "br":
                parts.append(" ")
            continue
        if name == "option":
            at = _OPTION.match(html, at).end()
            parts.append(" ")
            continue
        if name in UNREAD:
            foreign = name in ("svg", "math")
            if foreign and _empty(token.group(3)):
                parts.append(" ")
                continue
            end = None if name in endless else re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(html, at)
            if not end:
                endless.add(name)
            # without an end tag, HTML leaves svg and math at the next element of the page
            at = end.end() if end else at if foreign else len(html)
            parts.append(" ")
            continue
        if name in INLINE:
            in_link = name == "a" or in_link
            if name == "br":
                parts.append(" ")
            continue
        flush()
        ends = CLOSED_BY_NEXT.get(name, {"p"} if name in _ENDS_P else set())
        while path[-1].tag in ends:
            close()
        in_link = False
        if name not in VOID and not token.group(3).endswith("/"):
            path.append(Place(path[-1], name, tuple(p for groups in _NAMES.findall(token.group(3)) for p in _NAME_PARTS.findall("".join(groups).lower()))))
            opened[name] += 1
    flush()
    return found
