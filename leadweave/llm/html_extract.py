"""Main text of HTML pages by a linear-chain conditional random field over the leaf blocks.

Features of a block are the elements around it, the parts of their class, id and role values, and its text: length, share of links,
punctuation, place in the page. Features are hashed into a weight vector per label; a matrix scores neighbouring labels. Training maximises
the conditional likelihood of labelled pages; Viterbi finds the best labels of a page.

Labelled pages come from the pages themselves: in those that mark their parts by element (an ``article`` or ``main``), text inside it
and outside of navigation, forms and the like is main text. To learn class names too, each is laid out again under other marks in
``LAYOUTS``, with the labels known from the making. ``LABELLED`` bounds the pages used, those with the smallest hash of their address; training is a few
seconds on the driver whatever the table's size. Every page is read whole and decoded within its row.

Defined cases: null html is empty; a page without blocks, or with none labelled main, has an empty text. Null addresses are fine.
Repeated rows give repeated rows. Input columns named like a result are replaced by it. An empty table gives an empty result, and
with no labelled page at all the built-in sentences are the training text.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadweave.llm.html_blocks import Block, blocks

LABELLED = 200
DIMENSIONS = 1 << 13
STEPS, RATE, DECAY = 120, 0.15, 1e-4
MAIN_PARTS = ("article", "main")
OTHER_PARTS = frozenset("nav header footer aside form button dialog menu figure".split())
OTHER_NAMES = frozenset("ad ads advert advertisement banner sidebar comment comments reply replies menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent notice popup modal footer header share social related newsletter subscribe signup login form search widget promo sponsor sponsored toolbar pagination copyright disclaimer".split())

# Layouts a labelled page is rendered in: open and close marks of the whole, then of menu, notice, main text, side matter, comments and foot.
LAYOUTS = [
    {"menu": '<nav><ul>{}</ul></nav>', "notice": '<div class="ad">{}</div>', "main": '<article>{}</article>', "side": '<aside>{}</aside>', "comments": '<section class="comments">{}</section>', "foot": '<footer>{}</footer>'},
    {"menu": '<div class="menu">{}</div>', "notice": '<div class="cookie-notice">{}</div>', "main": '<div class="content">{}</div>', "side": '<div class="sidebar">{}</div>', "comments": '<div id="comments">{}</div>', "foot": '<div class="footer">{}</div>'},
    {"menu": '<header><div id="navbar">{}</div></header>', "notice": '<div class="banner">{}</div>', "main": '<main><div class="post-body">{}</div></main>', "side": '<div class="related">{}</div>', "comments": '<ol class="comment-list">{}</ol>', "foot": '<div id="footer">{}</div>'},
    {"menu": '<div role="navigation">{}</div>', "notice": '<div id="popup">{}</div>', "main": '<section class="entry article">{}</section>', "side": '<div class="widget promo">{}</div>', "comments": '<div class="replies">{}</div>', "foot": '<div class="copyright">{}</div>'},
    {"menu": '<ul class="nav breadcrumb">{}</ul>', "notice": '<form class="newsletter subscribe">{}</form>', "main": '<article class="story text">{}</article>', "side": '<aside class="sponsored">{}</aside>', "comments": '<div class="user-comment">{}</div>', "foot": '<footer class="site-footer">{}</footer>'},
    {"menu": '<table><tr><td>{}</td></tr></table>', "notice": '<p class="disclaimer">{}</p>', "main": '<div>{}</div>', "side": '<div class="share social">{}</div>', "comments": '<form>{}</form>', "foot": '<div>{}</div>'},
    {"menu": '<header>{}</header>', "notice": '<div class="advert">{}</div>', "main": '<main>{}</main>', "side": '<form><label>{}</label></form>', "comments": '<article><section id="reader-comments">{}</section></article>', "foot": '<footer>{}</footer>'},
]
SENTENCES = ["The river rose for three days, and on the fourth the bridge was closed.", "Nobody in the town had seen water that high since the old mill stood.",
             "When it fell again, the fields were grey with silt, and the repairs took until autumn.", "A second survey, made in spring, found the piers sound."]


def _kept(block: Block) -> bool:
    inner = block.path[max(block.path.index(p) for p in MAIN_PARTS if p in block.path):] if any(p in block.path for p in MAIN_PARTS) else None
    return inner is not None and not OTHER_PARTS & set(inner) and not OTHER_NAMES & set(block.names)


@lru_cache(maxsize=1 << 16)
def _place(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature) % DIMENSIONS


def features(page: list[Block]) -> list[np.ndarray]:
    """Hashed feature places of every block."""
    out = []
    for i, b in enumerate(page):
        n, words = len(b.text), b.text.count(" ") + 1
        found = {"any", f"tag {b.place.tag}", f"words {min(words.bit_length(), 6)}", f"links {4 * b.link_chars // max(n, 1)}",
                 f"stop {b.text[-1] in '.!?…'}", f"commas {min(b.text.count(','), 3)}", f"mark {b.text[0] if not b.text[0].isalnum() else ''}",
                 f"place {4 * i // len(page) if len(page) > 3 else ''}", f"inner {b.place.depth > 3}"}
        found |= {f"in {p}" for p in b.place.tags} | {f"name {p}" for p in b.place.name_set}
        out.append(np.array([_place(f) for f in sorted(found)]))
    return out


def rendered(main: list[str], other: dict[str, list[str]], layout: dict[str, str], rng: random.Random) -> tuple[str, list[bool]]:
    """A page of these texts in a layout, and for each block whether it is main text."""
    cells = {"menu": ("<li><a href='#'>{}</a></li>", other["menu"]), "notice": ("{}", other["notice"]), "main": ("<p>{}</p>", main), "side": ("<p>{}</p>", other["side"]),
             "comments": ("<p>{}</p>", other["comments"]), "foot": ("<p>{}</p>", other["foot"])}
    order = ["menu"] + (["side", "notice"] if rng.random() < 0.5 else ["notice"]) + ["main"] + [p for p in ("comments", "side") if rng.random() < 0.7] + ["foot"]
    html, labels = "", []
    for part in order:
        cell, texts = cells[part]
        if part == "main" and rng.random() < 0.7:
            texts = texts[:]
            inner = f"<h1>{texts[0]}</h1>" + "".join(cell.format(t) for t in texts[1:])
        else:
            inner = "".join(cell.format(t) for t in texts)
        html += layout[part].format(inner)
        labels += [part == "main"] * len(texts)
    return f"<html><body>{html}</body></html>", labels


def training_set(pages: list[str]) -> list[tuple[list[Block], list[bool]]]:
    """Labelled pages: those given that mark their main part, and every layout of them and of the built-in sentences."""
    rng, made, texts = random.Random(7), [], [([SENTENCES[0][:30], *SENTENCES], ["Home", "News", "About us"], ["We use cookies on this site."])]
    for html in pages:
        page = blocks(html)
        labels = [_kept(b) for b in page]
        if any(labels) and not all(labels):
            made.append((page, labels))
            main, rest = ([re.sub("[<>&]", " ", b.text) for b, kept in zip(page, labels) if kept is side] for side in (True, False))
            texts.append((main, [t for t in rest if t.count(" ") < 3] or ["Home"], [t for t in rest if t.count(" ") >= 3] or ["Some notice here, accept it."]))
    for main, short, long in texts:
        other = {"menu": short[:6], "notice": long[:1], "side": (long + short)[:3], "comments": [f"{m[:200]}" for m in main[1:3]] or long[:1], "foot": ["© " + long[-1][:60]]}
        alone = blocks("<body>" + "".join(rng.choice(LAYOUTS)["main"].format(f"<p>{m}</p>") for m in main[:rng.randint(1, 4)]))
        made.append((alone, [True] * len(alone)))
        for layout in rng.sample(LAYOUTS, 3) if len(texts) > 8 else LAYOUTS:
            html, labels = rendered(main, other, layout, rng)
            page = blocks(html)
            if len(page) == len(labels):
                made.append((page, labels))
    return made


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


class Field:
    """Weights ``w`` of features by label (0 other, 1 main) and ``t`` of neighbouring labels."""

    def __init__(self) -> None:
        self.w, self.t = np.zeros((DIMENSIONS, 2)), np.zeros((2, 2))

    def scores(self, page: list[np.ndarray]) -> np.ndarray:
        borders = np.cumsum([0] + [len(f) for f in page[:-1]])
        return np.add.reduceat(self.w[np.concatenate(page)], borders, axis=0)

    def marginals(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each block's label, and the sum over neighbours of each label pair's."""
        n = len(scores)
        ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
        ahead[0] = scores[0]
        for i in range(1, n):
            ahead[i] = scores[i] + _logsumexp(ahead[i - 1][:, None] + self.t, 0)
        for i in range(n - 2, -1, -1):
            behind[i] = _logsumexp(self.t + (scores[i + 1] + behind[i + 1])[None, :], 1)
        whole = _logsumexp(ahead[-1], 0)
        pairs = np.zeros((2, 2))
        for i in range(1, n):
            pairs += np.exp(ahead[i - 1][:, None] + self.t + (scores[i] + behind[i])[None, :] - whole)
        return np.exp(ahead + behind - whole), pairs

    def fit(self, labelled: list[tuple[list[Block], list[bool]]]) -> "Field":
        """Gradient ascent with per-weight steps on the conditional likelihood, in passes over batches of pages."""
        data = [(features(page), np.array(labels, np.int64)) for page, labels in labelled if page]
        rng, seen_w, seen_t = random.Random(11), np.full_like(self.w, 1e-8), np.full_like(self.t, 1e-8)
        for _ in range(STEPS):
            grad_w, grad_t = -DECAY * self.w, -DECAY * self.t
            for page, labels in rng.sample(data, min(len(data), 24)):
                sure, pairs = self.marginals(self.scores(page))
                off = np.eye(2)[labels] - sure
                for f, d in zip(page, off):
                    grad_w[f] += d
                np.add.at(grad_t, (labels[:-1], labels[1:]), 1.0)
                grad_t -= pairs
            seen_w += grad_w ** 2
            seen_t += grad_t ** 2
            self.w += RATE * grad_w / np.sqrt(seen_w)
            self.t += RATE * grad_t / np.sqrt(seen_t)
        return self

    def decode(self, page: list[np.ndarray]) -> list[int]:
        """The most likely labels."""
        if not page:
            return []
        (other, main), *rest = self.scores(page).tolist()
        (oo, om), (mo, mm) = self.t.tolist()
        back = []
        for s_other, s_main in rest:  # two labels: plain comparisons
            back.append((int(main + mo > other + oo), int(main + mm > other + om)))
            other, main = max(other + oo, main + mo) + s_other, max(other + om, main + mm) + s_main
        labels = [int(main > other)]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]


def main_text(html: str | None, field: Field) -> str:
    page = blocks(html)
    return "\n\n".join(b.text for b, label in zip(page, field.decode(features(page))) if label)


def fit_field(pages: DataFrame, url_col: str = "url", html_col: str = "html", labelled: int = LABELLED) -> Field:
    """A field fitted on at most ``labelled`` of the pages that mark a main part, those with the smallest hash of address and html."""
    marking = F.col(f"`{html_col}`").rlike(rf"(?i)<(?:{'|'.join(MAIN_PARTS)})[\s/>]")
    picked = pages.filter(marking).select(F.col(f"`{html_col}`").alias("html"), F.xxhash64(F.col(f"`{url_col}`"), F.xxhash64(F.col(f"`{html_col}`"))).alias("h"))
    least = picked.select("h").distinct().orderBy("h").limit(labelled)
    rows = picked.join(F.broadcast(least), "h").dropDuplicates(["h"]).orderBy("h").collect()
    return Field().fit(training_set([r.html for r in rows]))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", labelled: int = LABELLED) -> DataFrame:
    """The rows of ``pages`` with ``text`` and ``n_chars``."""
    field = fit_field(pages, url_col, html_col, labelled)

    @F.pandas_udf("string")
    def text_of(html: pd.Series) -> pd.Series:
        return html.map(lambda h: main_text(h, field))

    results = {"text", "n_chars"}
    read = pages.select(F.struct("*").alias("row"), text_of.asNondeterministic()(F.coalesce(F.col(f"`{html_col}`"), F.lit(""))).alias("text"))
    return read.select(*[F.col("row").getField(c).alias(c) for c in pages.columns if c not in results], "text", F.char_length("text").cast("bigint").alias("n_chars"))
