"""A small page tree for tests, built with the standard library's tokenizer."""

from __future__ import annotations

import random
from html.parser import HTMLParser

VOID = {"br", "meta", "img", "hr", "input", "link"}
# opening one of these closes an open one of the listed names, up to the nearest scope element
CLOSED_BY = {"td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}),
             "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})}


class Node:
    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children = tag, dict(attrs), parent, []

    def text(self):
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def walk(self):
        for c in self.children:
            if not isinstance(c, str):
                yield c
                yield from c.walk()

    def find(self, *names):
        return [n for n in self.walk() if n.tag in names]


class Tree(HTMLParser):
    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#", {}, None)
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in CLOSED_BY:
            closed, scope = CLOSED_BY[tag]
            node, last = self.at, None
            while node.parent and node.tag not in scope:
                if node.tag in closed:
                    last = node
                node = node.parent
            if last:
                self.at = last.parent
        node = Node(tag, attrs, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node.parent and node.tag != tag:
            node = node.parent
        if node.parent:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def squash(text):
    return " ".join(text.split())


def random_page(rng: random.Random) -> str:
    words = ["alpha", "Commission type", "Referral", "affiliate  manager", "Account Manager: Joe", "x &amp; y", "minimum payout", "$5", "net 30", " ", "1 < 2"]

    def text():
        return rng.choice(words)

    def close(tag):
        return f"</{tag}>" if rng.random() > 0.4 else ""

    def inline():
        return rng.choice([text, lambda: f"<strong>{text()}</strong>", lambda: f'<span class="x manager-name">{text()}</span>', lambda: f'<a title="t{rng.randint(0, 9)}@h.example" href="https://t.me/user_{rng.randint(0, 9)}">{text()}</a>',
                           lambda: "<br>", lambda: "<!-- account manager <td> -->", lambda: '<script>var a = "</td><div>";</script>'])()

    def block(depth):
        kind = rng.choice(["text", "text", "table", "list", "terms", "div", "p"]) if depth else "text"
        if kind == "table":
            rows = "".join("<tr>" + "".join(f"<{c}>{block(depth - 1)}{close(c)}" for c in rng.choices(["td", "th"], k=rng.randint(0, 3))) + close("tr") for _ in range(rng.randint(1, 3)))
            return f"<table>{rows}</table>"
        if kind == "list":
            return "<ul>" + "".join(f"<li>{block(depth - 1)}{close('li')}" for _ in range(rng.randint(1, 3))) + "</ul>"
        if kind == "terms":
            return "<dl>" + "".join(f"<dt>{inline()}{close('dt')}{rng.choice(['', ' '])}<dd>{block(depth - 1)}{close('dd')}" for _ in range(rng.randint(1, 2))) + "</dl>"
        if kind == "div":
            return f"<div>{block(depth - 1)}{block(depth - 1)}</div>"
        if kind == "p":
            return f"<p>{inline()}"
        return inline() + inline()

    return f"<html><body>{''.join(block(3) for _ in range(4))}</body></html>"


def kv_rows(tree):
    out = []
    for row in tree.root.find("tr"):
        cells = row.find("td", "th")
        if len(cells) > 1:
            out.append((cells[0].text(), cells[1].text()))
    return out


def kv_pairs(tree):
    out = []
    for term in tree.root.find("dt"):
        siblings = [c for c in term.parent.children if not isinstance(c, str)]
        after = siblings[siblings.index(term) + 1:]
        out.append((term.text(), after[0].text() if after else ""))
    return out


def blocks(tree, phrases):
    return [n for n in tree.root.find("tr", "li", "div") if any(p in squash(n.text()).lower() for p in phrases)]


def block_name(node):
    for place in (".name", ".manager-name", "strong", "b", "h3", "h4"):
        hits = [n for n in node.walk() if (place[1:] in (n.attrs.get("class") or "").split() if place[0] == "." else n.tag == place)]
        if hits and hits[0].text().strip():
            return hits[0].text().strip()
    text = squash(node.text())
    return text.split(":", 1)[0].strip() if ":" in text else ""
