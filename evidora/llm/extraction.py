"""Main text of web pages: boosted trees over DOM nodes, decoded along the hierarchy.

Each element gets features of its tag, the words of its class, id and role, its depth and place among
its siblings, and its subtree (text, links, elements, blocks, punctuation). Gradient-boosted trees
give the probability that it is kept if its parent is. Decoding goes down the tree: below a dropped
element nothing is kept, so that ancestors and descendants never contradict each other.

The trees are trained here, on pages that ``sample_pages`` makes by rule: containers with and without
telling names, around made-up prose, in many orders. No page of a corpus is needed.

Defined cases: null or empty html gives an empty text; pages may end anywhere; plain text without any
element is the text itself; repeated rows give repeated rows; an empty table gives no rows; very long
pages are read whole, in linear time; other columns are ignored.
"""

from __future__ import annotations

import functools
import random
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, text_slices
from .dom import Node, Page, kept_text, read

#: Words of class, id and role names by kind.
NAMES = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc pagination pager tabs skip toolbar links",
    "head": "header masthead topbar banner logo branding hero",
    "foot": "footer colophon copyright legal bottom contentinfo",
    "side": "sidebar aside widget widgets related recommended recommendations trending popular rail complementary more",
    "notice": "notice cookie cookies consent gdpr alert notification popup modal overlay dialog disclaimer message toast",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner outbrain taboola",
    "form": "form search login signup signin register subscribe subscription newsletter contact",
    "talk": "comment comments commentlist discussion disqus reply replies respond reviews thread feedback",
    "share": "share sharing social follow tweet buttons",
    "good": "article content main post entry story text body page prose markdown column paragraph",
}
_KINDS = {k: frozenset(v.split()) for k, v in NAMES.items()}
_TAGS = ("nav", "header", "footer", "aside", "form", "article", "main", "section", "div", "p", "ul", "ol", "li", "h1", "h2", "h3", "table", "tr", "td", "blockquote", "pre", "body", "figure", "figcaption", "dl", "span", "a")
FEATURES = [*_TAGS, *_KINDS, "hidden", "rights", "depth", "place", "brothers", "alike", "chars", "own", "links", "density", "per_block", "blocks", "stops", "share", "up_share", "in_article", "last"]


def features(page: Page) -> np.ndarray:
    """A row for each node of the page."""
    nodes = page.nodes
    out = np.zeros((len(nodes), len(FEATURES)), np.float32)
    total = max(1, nodes[0].chars)
    inside = [False] * len(nodes)
    nk, first = len(_TAGS), len(_TAGS) + len(_KINDS)
    place_of = {t: i for i, t in enumerate(_TAGS)}
    tags = [Counter(nodes[c].tag for c in x.children) for x in nodes]
    for i, x in enumerate(nodes):
        row = out[i]
        if (t := place_of.get(x.tag)) is not None:
            row[t] = 1
        for j, kind in enumerate(_KINDS.values()):
            if x.tokens and not kind.isdisjoint(x.tokens):
                row[nk + j] = 1
        up: Node | None = nodes[x.parent] if i else None
        inside[i] = bool(up) and (inside[x.parent] or up.tag in ("article", "main"))
        brothers = up.children if up else [0]
        alike = tags[x.parent][x.tag] if up else 1
        row[first:] = (x.hidden, x.rights, x.depth, x.place, len(brothers), alike, np.log1p(x.chars), np.log1p(x.own_chars), x.link_chars / max(1, x.chars), x.elements / max(1, x.chars), x.chars / max(1, x.blocks), x.blocks, x.stops / max(1, x.chars), x.chars / total, x.chars / max(1, up.chars if up else total), inside[i], x.place == len(brothers) - 1)
    return out


class Boosted:
    """Gradient boosting of regression trees on binned features, for the logistic loss."""

    def __init__(self, rounds: int = 80, depth: int = 5, rate: float = 0.2, ridge: float = 1.0, bins: int = 32):
        self.rounds, self.depth, self.rate, self.ridge, self.bins = rounds, depth, rate, ridge, bins
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)], 1)  # bin > b means value > cuts[b]
        p = y.mean()
        self.base = float(np.log(p / (1 - p)))
        margin = np.full(len(y), self.base)
        nodes = 2 ** (self.depth + 1) - 1
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-margin))
            g, h = y - q, q * (1 - q)
            at = np.zeros(len(y), np.int64)
            column, cut, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
            for level in range(self.depth + 1):
                first, wide = 2**level - 1, 2**level
                here = np.flatnonzero(at >= first)  # rows that no leaf higher up has kept
                if not len(here):
                    break
                slot = at[here] - first
                gs, hs, size = (np.bincount(slot, w, wide) for w in (g[here], h[here], None))
                value[first : first + wide] = self.rate * gs / (hs + self.ridge)
                if level == self.depth:
                    break
                best, found, where = np.full(wide, 1e-6), np.full(wide, -1), np.zeros(wide, np.int64)
                for c in range(x.shape[1]):
                    if not (m := len(cuts[c])):
                        continue
                    key = slot * (m + 1) + binned[here, c]
                    gb, hb = (np.bincount(key, w[here], wide * (m + 1)).reshape(wide, m + 1).cumsum(1)[:, :-1] for w in (g, h))
                    gain = gb**2 / (hb + self.ridge) + (gs[:, None] - gb) ** 2 / (hs[:, None] - hb + self.ridge) - (gs**2 / (hs + self.ridge))[:, None]
                    gain[(hb < 1e-3) | (hs[:, None] - hb < 1e-3)] = 0
                    k = gain.argmax(1)
                    top = gain[np.arange(wide), k]
                    better = (top > best) & (size >= 8)
                    best[better], found[better], where[better] = top[better], c, k[better]
                for node in np.flatnonzero(found >= 0).tolist():
                    column[first + node], cut[first + node] = found[node], cuts[found[node]][where[node]]
                    rows = here[slot == node]
                    at[rows] = 2 * (first + node) + 1 + (x[rows, found[node]] > cut[first + node])
            self.trees.append((column, cut, value))
            margin += self._leaf(x, self.trees[-1])
        return self

    def _leaf(self, x: np.ndarray, tree) -> np.ndarray:
        column, cut, value = tree
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            c = column[at]
            at = np.where(c < 0, at, 2 * at + 1 + (x[rows, c] > cut[at]))
        return value[at]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum(self._leaf(x, t) for t in self.trees)


def decode(page: Page, margins: np.ndarray) -> list[bool]:
    """Keep or drop each node. A margin says how likely a node is kept if its parent is, so the choice
    goes down the tree, and nothing below a dropped node is kept."""
    out = [True] * len(page.nodes)
    for i in range(1, len(out)):  # parents come before their children
        out[i] = out[page.nodes[i].parent] and bool(margins[i] >= 0)
    return out


def sample_pages(n: int, seed: int = 7) -> list[tuple[str, list[str]]]:
    """Made-up pages: html whose elements of the article carry the attribute ``data-k``."""
    r = random.Random(seed)
    pick = lambda kind: r.choice(NAMES[kind].split())
    syllables = "ka lo mi ren tas vor el un shi der qua est bri no pel".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))

    def prose(low: int, high: int) -> str:
        out = [word() + r.choice(["", "", "", "", "", ",", "."]) for _ in range(r.randint(low, high))]
        return " ".join(out).capitalize() + r.choice([".", ".", ".", "", "!", ":"])

    def named(tag: str, kind: str | None, k: bool, body: str) -> str:
        name = ""
        if kind:
            name = f' {r.choice(["class", "class", "id"])}="{r.choice(["", word() + "-", "site-"]) if r.random() < 0.4 else ""}{pick(kind)}{r.choice(["", " " + word(), "-" + word()])}"'
        if tag == "p" and "<" in body:  # blocks would end the paragraph
            tag = "div"
        return f"<{tag}{name}{' data-k' * k}>{body}</{tag}>"

    def links(low: int, high: int) -> str:
        return "".join(f'<li><a href="/{word()}">{prose(1, 4)}</a></li>' for _ in range(r.randint(low, high)))

    def menu() -> str:
        body = r.choice([f"<ul>{links(2, 9)}</ul>", "".join(f'<a href="#">{word()}</a> ' for _ in range(r.randint(2, 7)))])
        return named("nav", None if r.random() < 0.6 else "menu", False, body) if r.random() < 0.7 else named(r.choice(["div", "section", "ul"]), "menu", False, body)

    def advert() -> str:
        return named(r.choice(["div", "div", "aside", "section", "p", "ins"]), "advert", False, r.choice([prose(2, 30), f"<p>{prose(2, 25)}</p>", f'<a href="#">{prose(2, 9)}</a>']))

    def notice() -> str:
        return named(r.choice(["div", "section", "aside", "p"]), "notice", False, r.choice([prose(4, 40), f"<p>{prose(4, 40)}</p><p>{prose(1, 5)}</p>"]))

    def head() -> str:
        body = r.choice([f"<h1>{prose(1, 4)}</h1>", f"<div>{prose(1, 6)}</div>", f"<p>{prose(2, 12)}</p>", prose(1, 5)]) + (menu() if r.random() < 0.4 else "")
        return named("header", None if r.random() < 0.6 else "head", False, body) if r.random() < 0.7 else named("div", "head", False, body)

    def foot() -> str:
        body = r.choice([f"&copy; {word()} {prose(2, 20)}", f"<p>{prose(2, 20)}</p>", f"<ul>{links(2, 6)}</ul><p>&copy; {prose(1, 9)}</p>", f"<div>{prose(3, 25)}</div>"])
        return named("footer", None if r.random() < 0.6 else "foot", False, body) if r.random() < 0.75 else named("div", "foot", False, body)

    def side() -> str:
        body = r.choice([f"<h3>{prose(1, 3)}</h3><ul>{links(2, 8)}</ul>", f"<p>{prose(3, 40)}</p>", f"<h2>{prose(1, 3)}</h2><p>{prose(5, 60)}</p>", prose(3, 20)])
        return named("aside", None if r.random() < 0.6 else "side", False, body) if r.random() < 0.65 else named(r.choice(["div", "section"]), "side", False, body)

    def form() -> str:
        body = f"<label>{prose(1, 4)}</label><input name=a>{prose(0, 6)}" + (f"<p>{prose(2, 15)}</p>" if r.random() < 0.5 else "")
        return named("form", None if r.random() < 0.6 else "form", False, body) if r.random() < 0.75 else named("div", "form", False, f"<form>{body}</form>")

    def talk() -> str:
        one = lambda: named(r.choice(["div", "li", "article", "p"]), r.choice(["talk", "talk", None]), False, r.choice([prose(2, 60), f"<p>{prose(2, 60)}</p>", f"<h4>{prose(1, 2)}</h4><p>{prose(2, 50)}</p><p>{prose(2, 30)}</p>"]))
        body = (f"<h2>{prose(1, 3)}</h2>" if r.random() < 0.6 else "") + "".join(one() for _ in range(r.randint(1, 6)))
        return named(r.choice(["section", "div", "ol", "ul"]), "talk", False, body)

    def share() -> str:
        return named(r.choice(["div", "ul", "p"]), "share", False, r.choice([links(2, 5), prose(1, 6)]))

    def block() -> str:
        x = r.random()
        if x < 0.72:
            body = r.choice([prose(1, 1), prose(1, 3), prose(3, 15), prose(10, 60), prose(40, 140)])
            if r.random() < 0.25:
                body = f'{prose(2, 9)} <a href="#">{prose(1, 4)}</a> {body}'
            if r.random() < 0.2:
                return f"<p data-k><b>{body}<br>"
            return f"<p data-k>{body}</p>" if r.random() < 0.85 else f"<p data-k>{body}"
        if x < 0.82:
            return f"<h{(d := r.randint(2, 4))} data-k>{prose(1, 8)}</h{d}>"
        if x < 0.9:
            return "<ul data-k>" + "".join(f"<li data-k>{prose(1, 25)}</li>" for _ in range(r.randint(1, 6))) + "</ul>"
        if x < 0.94:
            return f"<blockquote data-k>{r.choice([prose(4, 40), f'<p data-k>{prose(4, 40)}</p>'])}</blockquote>"
        if x < 0.97:
            return "<table data-k>" + "".join("<tr data-k>" + "".join(f"<td data-k>{prose(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>"
        return f"<figure data-k><figcaption data-k>{prose(2, 12)}</figcaption></figure>"

    def article() -> str:
        body = (f"<h1 data-k>{prose(1, 12)}</h1>" if r.random() < 0.75 else "")
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 16, 60])):
            body += block()
            if r.random() < 0.04:
                body += r.choice([advert, share, side, notice, form])()
        if r.random() < 0.15:
            body = r.choice([prose(1, 4), prose(5, 40)]) + body + r.choice(["", prose(1, 5)])
        x = r.random()
        if x < 0.5:
            return named("article", None if r.random() < 0.7 else "good", True, body)
        if x < 0.7:
            return named("main", None if r.random() < 0.6 else "good", True, body)
        return named(r.choice(["div", "section"]), "good" if r.random() < 0.85 else None, True, body)

    pages = []
    for _ in range(n):
        some = lambda f, p: f() if r.random() < p else ""
        middle = article()
        if r.random() < 0.25:
            middle = middle[: middle.rindex("</")] + some(talk, 0.5) + some(share, 0.3) + some(form, 0.3) + middle[middle.rindex("</") :]
        around = some(side, 0.25) + middle + some(side, 0.3) + some(talk, 0.3)
        if r.random() < 0.4:
            around = named(r.choice(["div", "main", "section"]), r.choice(["good", None]), True, around)
        front = [some(head, 0.4), some(menu, 0.6), some(advert, 0.4), some(notice, 0.25), some(form, 0.15)]
        back = [some(advert, 0.15), some(form, 0.2), some(notice, 0.1), some(share, 0.1), some(foot, 0.7)]
        r.shuffle(front)
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            around = named(r.choice(["div", "div", "section"]), r.choice(["good", None, None]), True, around)
        opening = r.choice(["<html data-k><head><title>x</title></head><body data-k>"] * 3 + ["<body data-k>", ""])
        pages.append(f"{opening}{''.join(front)}{around}{''.join(back)}" + r.choice(["</body></html>" if opening else "", ""]))
    return pages


@functools.lru_cache(maxsize=2)
def train(n: int = 700, seed: int = 7) -> Boosted:
    """Trees fitted on made-up pages; deterministic, and done once in a process."""
    xs, ys = [], []
    for source in sample_pages(n, seed):
        page = read(source.replace(" data-k", ' role="datak"'))
        marked = [("datak" in x.tokens) for x in page.nodes]
        marked[0] = True
        for x in page.nodes:
            x.tokens = x.tokens - {"datak"}
        asked = np.array([i > 0 and marked[x.parent] for i, x in enumerate(page.nodes)])
        xs.append(features(page)[asked])
        ys.append(np.array(marked, float)[asked])
    return Boosted().fit(np.vstack(xs), np.concatenate(ys))


def extract(sources: list[str], model: Boosted) -> list[str]:
    pages = [read(s) for s in sources]
    if not pages:
        return []
    rows = [features(p) for p in pages]
    margins, at, out = model.margin(np.vstack(rows)), 0, []
    for page, x in zip(pages, rows):
        m = margins[at : at + len(x)]
        at += len(x)
        out.append(kept_text(page, decode(page, m)))
    return out


def extract_pages(pages: DataFrame, model: Boosted) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            texts = extract(b.column(2).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    source = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    return map_texts(source, run, f"page_id {source.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint")
