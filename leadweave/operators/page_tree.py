"""The tree of a page out of its tags: implied rows, closes, content moved out of tables, re-opened formatting.

The JVM cuts a page into tokens and turns each into a short code (:func:`token_codes`): a tag's name, ``/name``, ``#`` for text, nothing for
white space. Only these codes go through Python, as one string a page; texts and attributes never leave the JVM. ``page_tree``
follows the HTML standard's insertion rules over them and gives the elements in tree order, with the range of texts that each
holds. No row moves for it.

Bounds, all documented and none dropping text: elements deeper than ``DEPTH`` become siblings, and of formatting elements left open
the last ``REOPENED`` are opened again in a later block. Every tag costs at most the depth of the stack, so a page costs its length.
Not followed: templates' own insertion modes, framesets, the rules inside ``select`` and inside SVG and MathML.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from leadweave.functions.lists import Col, col

DEPTH, REOPENED = 512, 64
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
_SILENT_VOID = frozenset("base basefont bgsound col frame hr link meta param source track".split())  # they open no formatting again
_BODIES = frozenset("tbody thead tfoot".split())
_CELLS = frozenset("td th".split())
_PARTS = _BODIES | _CELLS | frozenset("caption col colgroup tr".split())
_TABLE_LEVEL = _BODIES | frozenset("table tr".split())
_MARKED = _CELLS | frozenset("caption applet marquee object".split())
_SCOPE = _MARKED | frozenset("table template".split())
_BUTTON_SCOPE, _LIST_SCOPE = _SCOPE | {"button"}, _SCOPE | {"ol", "ul"}
_CLOSES_P = _HEADINGS | frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup hr li dd dt listing main menu nav ol p pre search section summary ul xmp".split())
_BLOCK_ENDS = (_CLOSES_P | frozenset("button".split())) - _HEADINGS - frozenset("hr li dd dt p xmp".split())
_SPECIAL = _CLOSES_P | RAW | _PARTS | (_VOID - {"bgsound"}) | frozenset("applet bgsound body button frameset head html marquee object plaintext select table template".split()) - {"dialog"}
_IGNORED = frozenset("html head body frameset frame".split())
_IN_PLACE = frozenset("script style template".split())


def token_codes(raws: Col) -> Column:
    """One line a token, see above. Formatting tags carry a hash of how they are written, hidden inputs say so; lines hold no other blank."""
    def code(raw: Column) -> Column:
        name = F.lower(F.regexp_extract(raw, r"^</?([a-zA-Z][^\s/>]*)", 1))
        opened = F.when(name.isin(*sorted(FORMATTING)), F.concat_ws(" ", name, F.hash(raw))).when((name == "input") & raw.rlike(r"""(?i)[\s"'/]type\s*=\s*["']?hidden"""), "input hidden").otherwise(name)
        text = F.when(raw.rlike(r"[^ \t\n\f\r]"), "#").otherwise("")
        return F.when(~raw.startswith("<") | (raw == "<"), text).when(name == "", "!").when(raw.startswith("</"), F.concat(F.lit("/"), name)).otherwise(opened)

    return F.array_join(F.transform(col(raws), code), "\n")


class _Page:
    """Elements as parallel lists; element 0 is the page. ``kids`` hold elements and, as ``~token``, texts."""

    def __init__(self) -> None:
        self.tag, self.token, self.kids, self.place, self.on_stack = [""], [-1], [[]], [None], [True]
        self.before: dict[int, list[int]] = {}  # what was moved out of a table, to stand before it
        self.stack, self.opened, self.unpushed = [0], Counter(), Counter()
        self.active: list[tuple | None] = []  # formatting elements (tag, hash, token, element), None where a cell begins

    # -- the stack of open elements
    def top(self) -> str:
        return self.tag[self.stack[-1]]

    def find(self, names, barrier) -> int:
        """Place on the stack of the nearest open element of these names, 0 if there is none before a barrier."""
        for at in range(len(self.stack) - 1, 0, -1):
            tag = self.tag[self.stack[at]]
            if tag in names:
                return at
            if tag in barrier:
                return 0
        return 0

    def close_from(self, at: int) -> None:
        for element in self.stack[at:]:
            self.on_stack[element] = False
            self.opened[self.tag[element]] -= 1
            if self.tag[element] in _MARKED:
                while self.active and self.active.pop() is not None:
                    pass
        del self.stack[at:]

    def close_above(self, names) -> None:
        at = len(self.stack)
        while at > 1 and self.tag[self.stack[at - 1]] not in names:
            at -= 1
        self.close_from(at)

    def new(self, tag: str, token: int) -> int:
        self.tag.append(tag)
        self.token.append(token)
        self.kids.append([])
        self.place.append(None)
        self.on_stack.append(False)
        return len(self.tag) - 1

    def put(self, child: int, parent: int, in_place: bool = False) -> None:
        """Into the parent; what does not belong into a table goes before it."""
        where = self.kids[parent]
        if not in_place and self.tag[parent] in _TABLE_LEVEL:
            table = next((e for e in reversed(self.stack) if self.tag[e] == "table"), 0)
            where = self.before.setdefault(table, []) if table else self.kids[0]
        where.append(child)
        if child >= 0:
            self.place[child] = where

    def insert(self, tag: str, token: int, push: bool = True, in_place: bool = False) -> int:
        element = self.new(tag, token)
        self.put(element, self.stack[-1], in_place)
        if push and len(self.stack) < DEPTH:
            self.push(element, len(self.stack))
        elif push:
            self.unpushed[tag] += 1
        return element

    def push(self, element: int, at: int) -> None:
        self.stack.insert(at, element)
        self.on_stack[element] = True
        self.opened[self.tag[element]] += 1

    # -- formatting
    def reopen(self) -> None:
        first = len(self.active)
        while first and self.active[first - 1] is not None and not self.on_stack[self.active[first - 1][3]]:
            first -= 1
        for i in range(first, len(self.active)):
            tag, written, token, _ = self.active[i]
            self.active[i] = (tag, written, token, self.insert(tag, token))

    def format(self, tag: str, written: str, token: int) -> None:
        self.reopen()
        since = next((i + 1 for i in range(len(self.active) - 1, -1, -1) if self.active[i] is None), 0)
        same = [i for i in range(since, len(self.active)) if self.active[i][:2] == (tag, written)]
        if len(same) > 2:
            del self.active[same[0]]
        elif len(self.active) - since >= REOPENED:
            del self.active[since]
        self.active.append((tag, written, token, self.insert(tag, token)))

    def entry(self, element: int) -> int:
        return next((i for i in range(len(self.active) - 1, -1, -1) if self.active[i] and self.active[i][3] == element), -1)

    def end_formatting(self, tag: str) -> None:
        """Close a formatting element; blocks that begin inside it keep their part of it as a copy."""
        if self.top() == tag and self.entry(self.stack[-1]) < 0:
            self.close_from(len(self.stack) - 1)
            return
        for _ in range(8):
            at = len(self.active) - 1
            while at >= 0 and self.active[at] is not None and self.active[at][0] != tag:
                at -= 1
            if at < 0 or self.active[at] is None:
                self.end_other(tag)
                return
            element = self.active[at][3]
            if not self.on_stack[element]:
                del self.active[at]
                return
            low = self.stack.index(element)
            if any(self.tag[e] in _SCOPE for e in self.stack[low + 1:]):
                return
            high = next((i for i in range(low + 1, len(self.stack)) if self.tag[self.stack[i]] in _SPECIAL), 0)
            if not high:
                self.close_from(low)
                del self.active[at]
                return
            block = moved = self.stack[high]
            kept, bookmark = 0, at
            for i in range(high - 1, low, -1):
                between = self.stack[i]
                mine = self.entry(between)
                kept += 1
                if mine >= 0 and kept > 3:
                    del self.active[mine]
                    at, bookmark, mine = at - (mine < at), bookmark - (mine < bookmark), -1
                self.on_stack[between] = False
                self.opened[self.tag[between]] -= 1
                del self.stack[i]
                if mine < 0:
                    continue
                copy = self.new(self.tag[between], self.token[between])
                self.active[mine] = (*self.active[mine][:3], copy)
                self.push(copy, i)
                if moved == block:
                    bookmark = mine + 1
                self.move(moved, copy)
                moved = copy
            self.move(moved, self.stack[low - 1])
            copy = self.new(tag, self.token[element])
            self.kids[copy], self.kids[block] = self.kids[block], []
            for child in self.kids[copy]:
                if child >= 0:
                    self.place[child] = self.kids[copy]
            self.put(copy, block, in_place=True)
            self.active.insert(bookmark, (*self.active[at][:3], copy))
            del self.active[at + (bookmark <= at)]
            self.on_stack[element] = False
            self.opened[tag] -= 1
            self.stack.remove(element)
            self.push(copy, self.stack.index(block) + 1)

    def move(self, child: int, parent: int) -> None:
        if self.place[child] is not None:  # a copy just made stands nowhere yet
            self.place[child].remove(child)
        self.put(child, parent)

    # -- tokens
    def text(self, token: int, blank: bool) -> None:
        in_table = self.top() in _TABLE_LEVEL
        if not (blank and in_table):
            self.reopen()
        self.put(~token, self.stack[-1], in_place=blank and in_table)

    def part(self, tag: str, token: int) -> None:
        """Captions, columns, rows and cells, with the rows that are implied."""
        if not self.find(("table",), ()):
            return
        rows = _BODIES | {"table"}
        self.close_above(rows | {"tr"} if tag in _CELLS else rows if tag == "tr" else ("table",))
        if tag in _CELLS or tag == "tr":
            if self.top() == "table":
                self.insert("tbody", -1, in_place=True)
            if tag in _CELLS and self.top() != "tr":
                self.insert("tr", -1, in_place=True)
        self.insert(tag, token, tag != "col", in_place=True)
        if tag in _MARKED:
            self.active.append(None)

    def start(self, tag: str, more: str, token: int) -> None:
        if tag in _IGNORED:
            return
        if tag in _PARTS:
            self.part(tag, token)
            return
        in_table = self.top() in _TABLE_LEVEL
        if tag == "table":
            structure = self.find(_PARTS | {"table"}, ())
            if structure and self.tag[self.stack[structure]] not in _MARKED:
                self.close_from(self.find(("table",), ()))
            self.insert(tag, token)
            return
        if in_table and (tag in _IN_PLACE or tag == "form" or (tag == "input" and more)):
            element = self.insert(tag, token, tag in _IN_PLACE, in_place=True)
            if tag in RAW:
                self.kids[element].append(~token)
            return
        if tag == "li" or tag in ("dd", "dt"):
            names = ("li",) if tag == "li" else ("dd", "dt")
            at = self.find(names, _SPECIAL - {"address", "div", "p"}) if any(self.opened[n] > 0 for n in names) else 0
            if at:
                self.close_from(at)
        if tag in _CLOSES_P and self.opened["p"] > 0:
            at = self.find(("p",), _BUTTON_SCOPE)
            if at:
                self.close_from(at)
        if (tag in _HEADINGS and self.top() in _HEADINGS) or (tag in ("option", "optgroup") and self.top() == "option"):
            self.close_from(len(self.stack) - 1)
        if tag == "button" and self.opened["button"] > 0 and self.find(("button",), _SCOPE):
            self.close_from(self.find(("button",), _SCOPE))
        if tag in FORMATTING:
            if tag == "a" and self.opened["a"] > 0:
                inner = next((e for e in reversed(self.active) if e is None or e[0] == "a"), None)
                if inner:
                    self.end_formatting("a")
                    at = self.entry(inner[3])
                    if at >= 0:
                        del self.active[at]
            self.format(tag, more, token)
        elif tag in _VOID:
            if tag not in _SILENT_VOID:
                self.reopen()
            self.insert(tag, token, push=False)
        else:
            if tag not in _SPECIAL or tag in ("applet", "marquee", "object", "button", "select"):
                self.reopen()
            element = self.insert(tag, token)
            if tag in RAW:
                self.kids[element].append(~token)
            if tag in _MARKED:
                self.active.append(None)

    def end_other(self, tag: str) -> None:
        at = self.find((tag,), _SPECIAL - {tag})
        if at:
            self.close_from(at)

    def end(self, tag: str) -> None:
        if self.unpushed[tag] > 0:
            self.unpushed[tag] -= 1
        elif tag == "br":
            self.start("br", "", -1)
        elif tag in FORMATTING:
            self.end_formatting(tag)
        elif tag not in _IGNORED and self.opened[tag if tag not in _HEADINGS else "h"] > 0 or tag in _HEADINGS:
            if tag in _PARTS or tag == "table":
                at = self.find((tag,), ("table",))
            elif tag in _HEADINGS:
                at = self.find(_HEADINGS, _SCOPE)
            elif tag == "p":
                at = self.find(("p",), _BUTTON_SCOPE)
            elif tag == "li":
                at = self.find(("li",), _LIST_SCOPE)
            elif tag in _BLOCK_ENDS or tag in ("dd", "dt", "applet", "marquee", "object"):
                at = self.find((tag,), _SCOPE - {tag})
            else:
                self.end_other(tag)
                return
            if at:
                self.close_from(at)

    def listed(self) -> dict[str, list]:
        """Elements in tree order: tag, token, range of texts, place after the last descendant, next sibling; and the tokens of the texts in tree order."""
        out: dict[str, list] = {n: [] for n in FIELDS}
        token, tag, first, until, last, following, i, texts = (out[n] for n in FIELDS)
        work: list[tuple[int, int]] = [(k, -1) for k in reversed(self.placed(0))]
        newest = {-1: -1}  # by parent: the child that was listed last
        while work:
            node, parent = work.pop()
            if node is None:  # all below ``parent`` has been listed
                until[parent], last[parent] = len(texts), len(token)
                newest.pop(parent, None)
            elif node < 0:
                texts.append(~node)
            else:
                at = len(token)
                if newest.get(parent, -1) >= 0:
                    following[newest[parent]] = at
                newest[parent] = at
                for column, value in ((token, self.token[node]), (tag, self.tag[node]), (first, len(texts)), (until, 0), (last, 0), (following, -1), (i, at)):
                    column.append(value)
                work.append((None, at))
                work.extend((k, at) for k in reversed(self.placed(node)))
        return out

    def placed(self, node: int) -> list[int]:
        """The children with what was moved out of a table before it."""
        kids = self.kids[node]
        if not self.before or not any(k in self.before for k in kids):
            return kids
        out: list[int] = []
        for k in kids:
            out += [*self.before.get(k, ()), k]
        return out if not any(k in self.before for k in set(out) - set(kids)) else self._nested(kids)

    def _nested(self, kids: list[int]) -> list[int]:
        out, work = [], list(reversed(kids))
        done: set[int] = set()
        while work:
            k = work.pop()
            if k in self.before and k not in done:
                done.add(k)
                work += [k, *reversed(self.before[k])]
            else:
                out.append(k)
        return out


FIELDS = {"ord": "int", "tag": "string", "start": "int", "end": "int", "last": "int", "next": "int", "i": "int", "texts": "int"}
SCHEMA = ", ".join(f"`{n}` array<{t}>" for n, t in FIELDS.items())


def tree_of(codes: str | None) -> dict[str, list]:
    """The elements of a page as parallel lists (``FIELDS``; ``texts`` are the tokens that hold text, in tree order)."""
    page = _Page()
    for token, code in enumerate(codes.split("\n")) if codes is not None else ():
        if code in ("", "#"):
            page.text(token, not code)
        elif code[0] == "/":
            page.end(code[1:])
        elif code != "!":
            tag, _, more = code.partition(" ")
            page.start(tag, more, token)
    return page.listed()


def _tree_or_error(codes: str | None) -> dict:
    try:
        return tree_of(codes) | {"error": None}
    except Exception as e:  # one page's fault is one row's result
        return tree_of(None) | {"error": f"{type(e).__name__}: {e}"}


def page_tree() -> Column:
    """Column function from token codes to the page's tree; a page that can't be read gives ``error`` instead, and its task goes on."""
    @F.pandas_udf(f"{SCHEMA}, error string")
    def build(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_tree_or_error(codes) for codes in pages], columns=[*FIELDS, "error"])

    return build.asNondeterministic()  # else every use of a field builds the tree again
