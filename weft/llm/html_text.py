"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

The trees score each block and run of text by its subtree's density, attribute words, depth, siblings and place. A
node is main if its subtree holds main text. Decoding picks the best-scoring set of nodes in which no node is kept below a dropped one,
so ancestors and descendants never contradict each other; the kept runs of text, in page order, are the page's text.

The model is trained here on pages that :func:`training_page` writes, with known main text: articles in many kinds of markup between
menus, headers, sidebars, notices, adverts, forms, reader comments and footers.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .boosting import Trees, fit
from .common import map_batches
from .dom import Node, features, parse

#: Pages that the model is trained on.
TRAINING_PAGES = 450
#: Marks main text in training pages; taken out before features are made.
_MARK = ""
_LIMIT = 6.0
#: Nodes that are scored together, but for a page that has more.
_NODES = 4096


# --- training pages --------------------------------------------------------------------------------------------


def training_page(r: random.Random) -> str:
    """A page whose runs of main text start with a mark."""
    letters = "aeiouäéñlnrstdmpkgbvhcfw"

    def word() -> str:
        return "".join(r.choice(letters) for _ in range(r.randint(1, 9)))

    def words(n: int) -> str:
        return " ".join(word() for _ in range(n))

    def sentence(low: int = 2, high: int = 18) -> str:
        return words(r.randint(low, high)).capitalize() + r.choice("...!?")

    def prose(n: int) -> str:
        odd = r.random() < 0.1  # text full of symbols
        out = " ".join(sentence() for _ in range(n))
        return " ".join(w + r.choice(["###", "***", "%%%", "&amp;&amp;"]) for w in out.split()) if odd else out

    def link(n: int) -> str:
        return f'<a href="/{word()}">{words(n)}</a>'

    def attr(*names: str, chance: float = 0.75) -> str:
        if r.random() > chance:
            return ""
        return f' {r.choice(["class", "class", "id"])}="{r.choice(["", "c-", "site-", "the_"])}{r.choice(names)}{r.choice(["", " x1", "-wrap", " block"])}"'

    def inline(text: str, mark: bool) -> str:
        parts = text.split(" ")
        if len(parts) > 3 and r.random() < 0.4:
            i = r.randrange(len(parts))
            tag = r.choice(["b", "em", "span", "a href='#'", "strong", "code"])
            parts[i] = f"<{tag}>{parts[i]}</{tag.split()[0]}>"
        text = " ".join(parts)
        if r.random() < 0.1:
            text = text.replace(" ", "<br>", 1)
        return (_MARK if mark else "") + text

    def listed(n: int, item) -> str:
        tag = r.choice(["ul", "ul", "ol"])
        end = "</li>" if r.random() < 0.8 else ""
        return f"<{tag}>" + "".join(f"<li>{item()}{end}" for _ in range(n)) + f"</{tag}>"

    def menu() -> str:
        kind = r.choice(["nav", "nav", "div", "ul"])
        items = listed(r.randint(2, 12), lambda: link(r.randint(1, 3)))
        return f'<{kind}{attr("menu", "nav", "navbar", "navigation", "breadcrumbs")}>{items}</{kind}>'

    def header() -> str:
        kind = r.choice(["header", "div"])
        body = f"<{r.choice(['div', 'p', 'h1'])}>{words(r.randint(1, 4))}"
        return f'<{kind}{attr("header", "masthead", "top", "logo", chance=1 if kind == "div" else 0.4)}>{body}{menu() if r.random() < 0.5 else ""}</{kind}>'

    def footer() -> str:
        kind = r.choice(["footer", "footer", "div"])
        text = f"&copy; {word()}.example {r.choice(['&middot; ', '| ', ''])}{sentence()}"
        inner = text if r.random() < 0.6 else f"<p>{text}</p>{menu() if r.random() < 0.4 else ''}"
        return f'<{kind}{attr("footer", "copyright", "legal", chance=1 if kind == "div" else 0.4)}>{inner}</{kind}>'

    def side() -> str:
        kind = r.choice(["aside", "aside", "div", "section"])
        inner = [f"<h{r.randint(2, 4)}>{words(2)}</h3>", listed(r.randint(1, 6), lambda: link(r.randint(2, 8))), f"<p>{prose(r.randint(1, 3))}</p>"]
        r.shuffle(inner)
        return f'<{kind}{attr("sidebar", "widget", "related", "rail", "popular", "share", chance=1 if kind in ("div", "section") else 0.5)}>{"".join(inner[: r.randint(1, 3)])}</{kind}>'

    def advert() -> str:
        text = r.choice([sentence(), prose(2), link(6), f"<p>{prose(r.randint(1, 3))}</p>"])
        return f'<div{attr("ad", "ads", "advert", "sponsored", "promo", "banner", chance=1)}>{text}</div>'

    def notice() -> str:
        kind = r.choice(["div", "section", "aside", "dialog"])
        text = prose(r.randint(1, 3))
        return f'<{kind}{attr("cookie", "notice", "consent", "alert", "modal", "disclaimer", chance=1)}>{r.choice([text, f"<p>{text}</p>"])}{r.choice(["", "<button>" + word() + "</button>"])}</{kind}>'

    def form() -> str:
        fields = "".join(f"<label>{words(2)}<input name=x></label>" for _ in range(r.randint(0, 4)))
        return f'<form{attr("login", "subscribe", "search", "newsletter")}><p>{sentence()}</p>{fields}<select><option>{word()}<option>{word()}</select><button>{word()}</button></form>'

    def comments() -> str:
        kind = r.choice(["section", "div", "ul", "ol"])
        name = attr("comments", "replies", "discussion", "respond", chance=1)
        one = r.choice(["div", "li", "article"])
        body = "".join(f'<{one}{attr("comment", "reply", chance=0.7)}><b>{word()}</b>{r.choice(["<p>", " "])}{prose(r.randint(1, 5))}</p></{one}>' for _ in range(r.randint(1, 6)))
        return f"<{kind}{name}>{r.choice(['', '<h3>' + words(2) + '</h3>'])}{body}{form() if r.random() < 0.3 else ''}</{kind}>"

    def block() -> str:
        x = r.random()
        if x < 0.68:
            text = prose(1 if r.random() < 0.25 else r.randint(1, 9))
            if r.random() < 0.12:
                return f"<p><b>{inline(sentence(), True)}<br><p>{inline(text, True)}</p>"
            return f"<p>{inline(text, True)}" + ("</p>" if r.random() < 0.85 else "")
        if x < 0.76:
            return f"<h{r.randint(2, 4)}>{inline(words(r.randint(1, 8)), True)}</h{r.randint(2, 4)}>"
        if x < 0.84:
            return listed(r.randint(2, 6), lambda: inline(sentence(), True))
        if x < 0.88:
            return f"<blockquote>{r.choice(['', '<p>'])}{inline(prose(2), True)}</blockquote>"
        if x < 0.91:
            return f"<table><tr><th>{_MARK}{word()}<th>{_MARK}{word()}<tr><td>{_MARK}{words(2)}<td>{_MARK}{words(3)}</table>"
        if x < 0.94:
            return f"<pre>{_MARK}{words(8)}\n{words(4)}</pre>"
        return f"<div>{inline(prose(r.randint(1, 4)), True)}</div>"

    def article() -> str:
        kind = r.choice(["article"] * 4 + ["main", "div", "div", "section"])
        name = attr("article", "content", "post", "entry", "story", "main", "text", chance=0.3 if kind in ("article", "main") else 0.8)
        title = f"<h1>{inline(words(r.randint(2, 12)), True)}</h1>" if r.random() < 0.85 else ""
        parts = [block() for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5, 8, 14]))]
        if not parts:  # hardly more than a title
            parts = [r.choice([f"<p><b>{inline(sentence(), True)}<br>", f"<p>{inline(sentence(), True)}</p>", ""])] if title else [f"<p>{inline(sentence(), True)}"]
        for extra, chance in ((advert, 0.25), (side, 0.15), (comments, 0.12), (form, 0.05), (menu, 0.08)):
            if r.random() < chance:
                parts.insert(r.randint(0, len(parts)), ("</p>" if r.random() < 0.5 else "") + extra())
        return f"<{kind}{name}>{title}{''.join(parts)}</{kind}>"

    before = [f for f, c in ((menu, 0.7), (header, 0.5), (advert, 0.5), (notice, 0.3), (form, 0.15), (side, 0.15)) if r.random() < c]
    after = [f for f, c in ((side, 0.4), (comments, 0.4), (advert, 0.2), (form, 0.2), (notice, 0.15), (menu, 0.2)) if r.random() < c]
    r.shuffle(before)
    r.shuffle(after)
    body = "".join(f() for f in before) + article() + "".join(f() for f in after) + (footer() if r.random() < 0.8 else "")
    for _ in range(r.choice([0, 0, 0, 1, 2])):
        body = f'<div{attr("page", "container", "wrapper")}>{body}</div>'
    head = f"<head><title>{words(5)}</title><style>p{{}}</style><script>if (a < b) t('</p>')</script></head>"
    return r.choice(["<!DOCTYPE html>", ""]) + f"<html>{head}<body>{body}{r.choice(['</body></html>', ''])}"


def _labelled(page: str) -> tuple[np.ndarray, np.ndarray]:
    nodes = parse(page)
    y = np.zeros(len(nodes))
    for i, d in enumerate(nodes):
        if _MARK in d.text:
            y[i] = 1
            d.text = d.text.replace(_MARK, "")
    for i in range(len(nodes) - 1, 0, -1):
        y[nodes[i].parent] = max(y[nodes[i].parent], y[i])
    return features(nodes)[1:], y[1:]


@functools.cache
def model(pages: int = TRAINING_PAGES, seed: int = 11) -> Trees:
    """The trees, trained once in a driver on ``pages`` pages."""
    r = random.Random(seed)
    x, y = zip(*(_labelled(training_page(r)) for _ in range(pages)), strict=True)
    return fit(np.concatenate(x), np.concatenate(y))


# --- extraction ------------------------------------------------------------------------------------------------


def decode(nodes: list[Node], log_odds: np.ndarray) -> np.ndarray:
    """Which nodes the best-scoring set without a kept node below a dropped one keeps; the root always is."""
    gain = np.clip(log_odds, -_LIMIT, _LIMIT).tolist()
    for i in range(len(nodes) - 1, 0, -1):  # children come after their parents
        if gain[i] > 0:
            gain[nodes[i].parent] += gain[i]
    kept = np.zeros(len(nodes), bool)
    kept[0] = True
    for i in range(1, len(nodes)):
        kept[i] = kept[nodes[i].parent] and gain[i] > 0
    return kept


def main_texts(pages: list[str], trees: Trees) -> list[str]:
    """The main text of each page; empty if it has none."""
    out: list[str] = []
    parsed: list[list[Node]] = []

    def flush() -> None:
        made = [features(nodes) for nodes in parsed]
        scores, at = trees.log_odds(np.concatenate(made)), 0
        for nodes in parsed:
            kept = decode(nodes, scores[at : at + len(nodes)])
            at += len(nodes)
            out.append(" ".join(" ".join(d.text.split()) for d, k in zip(nodes, kept, strict=True) if k and d.tag == "#text"))
        parsed.clear()

    for page in pages:
        parsed.append(parse(page))
        if sum(map(len, parsed)) > _NODES:
            flush()
    if parsed:
        flush()
    return out


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Id, url, ``text`` (main text, empty if there is none) and ``n_chars`` (its code points) of every page.

    The whole of each page is read; null is empty. Character references are decoded, white space (as Unicode has it, no-break spaces included) inside a block becomes one space,
    and blocks are joined by one space in page order. Repeated rows and null ids stay; an empty table gives no rows; other columns are not read.
    """
    trees = model()
    names = [id_column, url_column, "text", "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many = [p or "" for p in batch.column(2).to_pylist()]
            found = main_texts(many, trees)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], names=names)

    source = pages.select(pages[id_column].cast("long"), pages[url_column].cast("string"), pages[html_column].cast("string"))
    return map_batches(source, run, f"{id_column} long, {url_column} string, text string, n_chars long")
