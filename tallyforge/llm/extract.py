"""Main-text extraction with a tree-structured graphical model over the DOM.

Every element has a hidden label, content or not. A child depends on its parent through a potential, and an element's tag, the words of its
class, id and role, its length and its share of link text depend on its label. Messages go up the tree and down again (sum-product), which gives
each element's exact marginal probability of being content. All pages of a batch are worked on together, one level of depth at a time.

The model is learnt by counting on labelled pages: pages in whose markup the attribute data-content is 1 on content and 0 elsewhere, children
taking their parent's label unless they have their own. `labelled_pages` writes such pages from a catalogue of the layouts that
the web uses; pages labelled by hand can be given instead, or as well.

The text is that of the elements whose marginal reaches one half: character references decoded, white space inside a block one space, blocks
joined by a line feed in page order.

Defined results: null or empty html, and pages without content, give an empty text; broken markup is read as browsers read it, as far as blocks go;
repeated rows give equal texts; extra columns pass through.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.html_tree import CONTROLS, Page, parse
from tallyforge.llm.textcore import lean

# Words that layouts put into class, id and role.
CONTENT_NAMES = ["content", "main", "article", "post", "entry", "story", "body", "text", "page", "prose", "blog", "news", "section", "lead", "intro", "single"]
MENU_NAMES = ["nav", "menu", "navigation", "navbar", "breadcrumb", "breadcrumbs", "topnav", "toc", "pagination", "pager", "tabs", "links", "skip"]
HEADER_NAMES = ["header", "masthead", "banner", "branding", "logo", "top", "topbar", "site"]
FOOTER_NAMES = ["footer", "foot", "bottom", "copyright", "colophon", "legal", "contentinfo", "site"]
SIDE_NAMES = ["sidebar", "aside", "side", "widget", "related", "recommended", "trending", "popular", "complementary", "rail", "secondary", "tags", "archive", "more", "recent", "share", "social", "author", "bio"]
NOTICE_NAMES = ["cookie", "cookies", "consent", "notice", "notification", "alert", "gdpr", "privacy", "popup", "modal", "overlay", "disclaimer", "paywall", "toast", "warning", "message"]
ADVERT_NAMES = ["ad", "ads", "advert", "advertisement", "adsbygoogle", "sponsor", "sponsored", "promo", "promotion", "banner", "affiliate", "commercial", "dfp", "outbrain", "taboola", "adslot"]
FORM_NAMES = ["form", "newsletter", "subscribe", "signup", "login", "search", "searchbox", "contact", "poll", "register", "subscription"]
COMMENT_NAMES = ["comment", "comments", "commentlist", "reply", "replies", "respond", "discussion", "disqus", "reader", "responses", "feedback", "thread", "reviews"]


@dataclass
class TreeModel:
    """prior and step: log potentials of the root and of (parent, child); weight: log P(feature | content) - log P(feature | other)."""

    prior: np.ndarray
    step: np.ndarray
    weight: dict[str, float]


def _features(page: Page, k: int, chars: int, linked: int) -> list[str]:
    tag = page.tag[k]
    up = page.parent[k]
    density = 0 if not linked else 1 + min(3, int(4 * linked / max(chars, 1)))
    found = [f"t:{tag}", f"n:{min(9, chars.bit_length())}:{density}"]
    if up >= 0:
        found.append(f"u:{page.tag[up]}>{tag}")
    found += [f"w:{w}" for w in dict.fromkeys(page.tokens[k])]
    return found


def _totals(page: Page) -> tuple[list[int], list[int]]:
    """Characters and link characters below each node."""
    chars, linked = list(page.text_chars), list(page.link_chars)
    for k in range(len(chars) - 1, 0, -1):
        chars[page.parent[k]] += chars[k]
        linked[page.parent[k]] += linked[k]
    return chars, linked


#: Share of their evidence that features count with: they overlap, and counting each in full would be too sure of itself.
TEMPER = 0.45


def fit(pages: Iterable[str], temper: float = TEMPER) -> TreeModel:
    """The model counted from labelled pages."""
    prior, step = np.full(2, 0.5), np.full((2, 2), 0.5)
    seen = [Counter(), Counter()]
    total = [0, 0]
    for source in pages:
        page = parse(source)
        chars, linked = _totals(page)
        for k, label in enumerate(page.label):
            label = max(label, 0)
            if page.parent[k] < 0:
                prior[label] += 1
            else:
                step[max(page.label[page.parent[k]], 0), label] += 1
            total[label] += 1
            seen[label].update(_features(page, k, chars[k], linked[k]))
    weight = {}
    for f in seen[0].keys() | seen[1].keys():
        a, b = (seen[1][f] + 0.5) / (total[1] + 1), (seen[0][f] + 0.5) / (total[0] + 1)
        weight[f] = temper * math.log(a / b)
    return TreeModel(np.log(prior / prior.sum()), np.log(step / step.sum(axis=1, keepdims=True)), weight)


def marginals(pages: list[Page], model: TreeModel) -> list[np.ndarray]:
    """P(content) of every node of every page."""
    sizes = [len(p.parent) for p in pages]
    base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    parent, depth = np.full(base[-1], -1, dtype=np.int64), np.zeros(base[-1], dtype=np.int64)
    unary = np.zeros((base[-1], 2))
    weight = model.weight
    for page, b in zip(pages, base.tolist()):
        chars, linked = _totals(page)
        deep = [0] * len(chars)
        for k, up in enumerate(page.parent):
            if up >= 0:
                deep[k] = deep[up] + 1
            unary[b + k, 1] = sum(weight.get(f, 0.0) for f in _features(page, k, chars[k], linked[k]))
        depth[b : b + len(deep)] = deep
        parent[b : b + len(deep)] = [b + u if u >= 0 else -1 for u in page.parent]
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
    up = np.zeros_like(unary)  # message of each node to its parent, by the parent's label
    inner = unary.copy()  # own evidence and the messages from below
    for level in reversed(levels[1:]):
        up[level] = np.logaddexp(model.step[:, 0][None, :] + inner[level, 0:1], model.step[:, 1][None, :] + inner[level, 1:2])
        np.add.at(inner, parent[level], up[level])
    belief = inner.copy()
    belief[levels[0]] += model.prior
    for level in levels[1:]:
        rest = belief[parent[level]] - up[level]
        down = np.logaddexp(model.step[0][None, :] + rest[:, 0:1], model.step[1][None, :] + rest[:, 1:2])
        belief[level] += down
    shown = 1.0 / (1.0 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))
    return [shown[a:b] for a, b in zip(base, base[1:])]


def page_text(page: Page, shown: np.ndarray, least: float = 0.5) -> str:
    """The text of the nodes whose marginal is at least the threshold; controls never count."""
    blocks = []
    for _, pieces in page.runs:
        kept = " ".join("".join(t for at, t in pieces if shown[at] >= least and page.tag[at] not in CONTROLS).split())
        if kept:
            blocks.append(kept)
    return "\n".join(blocks)


def labelled_pages(n: int = 400, seed: int = 11) -> Iterator[str]:
    """Pages in many layouts with data-content on their elements, made from the catalogue of names above."""
    rng = random.Random(seed)
    letters = "etaoinshrdlucmfgypwbvk"

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(low, high)))

    def link() -> str:
        return f'<a href="/{words(1, 1)}">{words(1, 3)}</a>'

    def names(kinds: list[str], chance: float = 0.8) -> str:
        if rng.random() > chance:
            return ""
        some = "-".join(rng.sample(kinds, rng.randint(1, 2))) if rng.random() < 0.5 else " ".join(rng.sample(kinds, rng.randint(1, 2)))
        return f' {rng.choice(["class", "class", "id"])}="{some}"'

    def links() -> str:
        return "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(3, 9))) + "</ul>" if rng.random() < 0.8 else " | ".join(link() for _ in range(rng.randint(3, 8)))

    def paragraphs(low: int, high: int) -> str:
        return "".join(f"<p>{words(4, 60)}</p>" for _ in range(rng.randint(low, high)))

    def other(tags: list[str], kinds: list[str], inside: str) -> str:
        tag = rng.choice(tags)
        return f'<{tag}{names(kinds, 0.5 if tag not in ("div", "section") else 1.0)} data-content="0">{inside}</{tag}>'

    def menu() -> str:
        return other(["nav", "nav", "div", "ul"], MENU_NAMES, links())

    def header() -> str:
        return other(["header", "header", "div"], HEADER_NAMES, rng.choice(["", menu()]) + rng.choice([f"<h1>{words(1, 4)}</h1>", f"<p>{words(1, 6)}</p>", f"<div>{link()}</div>"]))

    def footer() -> str:
        return other(["footer", "footer", "div"], FOOTER_NAMES, rng.choice([f"&copy; {words(2, 12)}", f"<p>{words(3, 20)}</p>", links(), f"<p>&copy; {words(1, 3)}</p>{links()}"]))

    def side() -> str:
        return other(["aside", "aside", "div", "section"], SIDE_NAMES, rng.choice([f"<h3>{words(1, 3)}</h3>{links()}", f"<h2>{words(1, 3)}</h2><p>{words(5, 30)}</p>", links(), paragraphs(1, 3), words(4, 20)]))

    def notice() -> str:
        return other(["div", "div", "section", "aside", "dialog"], NOTICE_NAMES, rng.choice(["", "", f"<h3>{words(1, 4)}</h3>"]) + rng.choice([f"<p>{words(5, 30)}</p>", words(5, 30)]) + rng.choice(["", f"<button>{words(1, 2)}</button>", link()]))

    def advert() -> str:
        return other(["div", "div", "aside", "section", "p"], ADVERT_NAMES, rng.choice([words(3, 25), f"<p>{words(3, 25)}</p>", f"{link()} {words(3, 10)}"]))

    def form() -> str:
        return other(["form", "form", "div", "section"], FORM_NAMES, rng.choice(["", f"<h3>{words(1, 4)}</h3>"]) + rng.choice([f"<label>{words(1, 3)}</label><input><button>{words(1, 2)}</button>", f"<p>{words(4, 15)}</p><input><button>{words(1, 1)}</button>", f"<fieldset><legend>{words(1, 3)}</legend><select><option>{words(1, 1)}</option></select></fieldset>"]))

    def comments() -> str:
        one = lambda: rng.choice([f"<p>{words(4, 40)}</p>", f"<div>{words(4, 40)}</div>", f"<h4>{words(1, 2)}</h4><p>{words(4, 40)}</p>"])
        tag = rng.choice(["li", "div", "article"])
        title = f"<h{rng.randint(2, 4)}>{words(1, 4)}</h2>" if rng.random() < 0.6 else ""
        return other(["section", "div", "ol", "aside"], COMMENT_NAMES, title + "".join(f"<{tag}{names(COMMENT_NAMES, 0.7)}>{one()}</{tag}>" for _ in range(rng.randint(1, 5))))

    def body() -> str:
        parts = []
        for _ in range(rng.randint(1, 14)):
            kind = rng.random()
            if kind < 0.7:
                parts.append(f"<p>{words(1, 70)}</p>" if rng.random() < 0.85 else f"<p><b>{words(1, 20)}<br>")
            elif kind < 0.8:
                parts.append(f"<h{rng.randint(2, 4)}>{words(1, 8)}</h2>")
            elif kind < 0.86:
                parts.append("<ul>" + "".join(f"<li>{words(3, 20)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
            elif kind < 0.9:
                parts.append(f"<blockquote><p>{words(4, 30)}</p></blockquote>")
            elif kind < 0.93:
                parts.append(f"<figure><img><figcaption>{words(3, 12)}</figcaption></figure>")
            elif kind < 0.96:
                parts.append(f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr></table>")
            else:
                parts.append(f"<p>{words(3, 20)} {link()} {words(3, 20)}</p>")
            if rng.random() < 0.06:
                parts.append(rng.choice([advert, notice, form, side])())
        title = f"<h1>{words(2, 10)}</h1>"
        return (f"<header>{title}</header>" if rng.random() < 0.2 else title if rng.random() < 0.9 else "") + "".join(parts)

    for _ in range(n):
        tag = rng.choice(["article", "article", "article", "main", "div", "section"])
        text = f'<{tag}{names(CONTENT_NAMES, 0.4 if tag in ("article", "main") else 1.0)} data-content="1">{body()}</{tag}>'
        below = "".join(p() for p in rng.sample([comments, form, side, notice, advert], rng.randint(0, 2)))
        if rng.random() < 0.3:
            text = text[: text.rindex("</")] + below + text[text.rindex("</") :]
            below = ""
        if rng.random() < 0.3:
            wrap = rng.choice(["div", "main", "section"])
            text = f'<{wrap}{names(CONTENT_NAMES, 0.5)} data-content="{int(wrap == "main")}">{text}{rng.choice(["", side()])}</{wrap}>'
        above = "".join(p() for p in rng.sample([header, menu, advert, notice, form], rng.randint(1, 3)))
        yield f"<html><head><title>{words(2, 8)}</title></head><body>{above}{text}{below}{footer() if rng.random() < 0.9 else ''}</body></html>"


def extracted(pages: DataFrame, model: TreeModel | None = None, html: str = "html") -> DataFrame:
    """The rows with text, the main text of their html; a column of that name is replaced."""
    model = model or fit(labelled_pages())
    shared = pages.sparkSession.sparkContext.broadcast((model.prior, model.step, model.weight))
    rows = pages.drop("text") if "text" in pages.columns else pages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TreeModel(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                trees = [parse(source or "") for source in part.column(html).to_pylist()]
                texts = [page_text(tree, shown) for tree, shown in zip(trees, marginals(trees, own))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "text"])

    schema = T.StructType([*rows.schema.fields, T.StructField("text", T.StringType())])
    return rows.mapInArrow(lean(run), schema)


def with_length(rows: DataFrame) -> DataFrame:
    return rows.withColumn("n_chars", F.length("text").cast("long"))
