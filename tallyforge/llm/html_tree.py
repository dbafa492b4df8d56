"""A small DOM of block elements: what the extraction model needs of a page, and no more."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

# Elements by their role in the HTML standard.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HIDDEN = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "head", "title", "canvas", "audio", "video", "map"}
RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "xmp"}
CONTROLS = {"button", "select", "option", "optgroup", "textarea", "label", "output", "datalist", "meter", "progress"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu",
    "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Opening one of these closes an open one of the others, up to the element in which they live.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}),
}
CHOICES = {"option", "select", "datalist", "optgroup"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_MEANING = ("class", "id", "role", "itemprop", "aria-label", "rel")


@dataclass
class Page:
    """Nodes in page order, a parent before its children; texts are runs of one block that no other block interrupts."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    tokens: list[list[str]] = field(default_factory=list)
    label: list[int] = field(default_factory=list)
    text_chars: list[int] = field(default_factory=list)
    link_chars: list[int] = field(default_factory=list)
    runs: list[tuple[int, list[tuple[int, str]]]] = field(default_factory=list)


def _attributes(raw: str) -> tuple[list[str], int, bool]:
    """Words of the attributes that carry meaning, the training label (-1: none), and whether the element is hidden."""
    words, label, hidden = [], -1, False
    for name, value in _ATTRIBUTE.findall(raw):
        name = name.lower()
        value = html.unescape(value.strip("\"'"))
        if name in _MEANING:
            words += [w.lower() for w in _WORD.findall(value)]
        elif name == "data-content":
            label = int(value == "1")
        elif name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)) or (name == "aria-hidden" and value == "true"):
            hidden = True
    return words, label, hidden


def parse(source: str) -> Page:
    """The page's tree. Never fails: what cannot be understood is text, and what is left open ends with the page."""
    page = Page()
    stack: list[tuple[str, int]] = []  # every open element, with its node: its own or that of the block around it
    # What a tag can close is known without a walk over the stack, so that unmatched tags cost nothing, however deep the page is nested:
    opened: Counter[str] = Counter()  # names on the stack; a hidden block counts by its own
    blocks: list[int] = []  # depths of the open blocks
    inline: list[Counter[str]] = [Counter()]  # names since each of them
    choices: list[int] = []  # depths of open options and what holds them
    links = hidden = 0
    run_open = False

    def node(tag: str, words: list[str], label: int) -> int:
        up = stack[-1][1] if stack else -1
        page.parent.append(up)
        page.tag.append(tag)
        page.tokens.append(words)
        page.label.append(label if label >= 0 or up < 0 else page.label[up])
        page.text_chars.append(0)
        page.link_chars.append(0)
        return len(page.parent) - 1

    root = node("html", [], -1)
    stack.append(("html", root))

    def text(raw: str) -> None:
        nonlocal run_open
        if hidden or not raw:
            return
        at = stack[-1][1]
        value = html.unescape(raw) if "&" in raw else raw
        if not run_open:
            if not value.strip():
                return
            page.runs.append((at, []))
            run_open = True
        page.runs[-1][1].append((at, value))
        n = len(value) - value.count(" ")
        page.text_chars[at] += n
        if links:
            page.link_chars[at] += n

    def close_to(depth: int) -> None:
        nonlocal links, hidden, run_open
        while len(stack) > depth:
            tag, at_node = stack.pop()
            opened[page.tag[at_node] if tag == "#hidden" else tag] -= 1
            if blocks and blocks[-1] == len(stack):
                blocks.pop()
                inline.pop()
            else:
                inline[-1][tag] -= 1
            if choices and choices[-1] == len(stack):
                choices.pop()
            links -= tag == "a"
            hidden -= tag in HIDDEN or tag == "#hidden"
            if tag in BLOCKS or tag == "#hidden":
                run_open = False

    at = 0
    while True:
        m = _TOKEN.search(source, at)
        if m is None:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        end, start = m.group(1), m.group(2)
        if end is not None:
            end = end.lower()
            crosses = end in BLOCKS or end in HIDDEN
            if opened[end] if crosses else inline[-1][end]:
                depth = len(stack) - 1
                while stack[depth][0] != end and not (stack[depth][0] == "#hidden" and page.tag[stack[depth][1]] == end):
                    depth -= 1
                close_to(depth)
            continue
        if start is None:
            continue
        start = start.lower()
        if start in BLOCKS:
            run_open = False
            if start in ("html", "body") and len(stack) == 1:
                continue
            if start not in ("li", "td", "th", "tr", "dt", "dd"):
                # a paragraph ends where a block begins, if it is the innermost block
                if blocks and stack[blocks[-1]][0] == "p":
                    close_to(blocks[-1])
        if start == "option" and choices and stack[choices[-1]][0] == "option":
            close_to(choices[-1])
        elif start in CLOSES:
            ended, home = CLOSES[start]
            at_block = len(blocks) - 1
            while at_block >= 0 and any(opened[e] for e in ended):
                depth = blocks[at_block]
                if stack[depth][0] in home:
                    break
                if stack[depth][0] in ended:
                    close_to(depth)
                    if start != "tr":
                        break
                at_block = min(at_block, len(blocks)) - 1
        if start == "body":
            continue
        if start == "br":
            text(" ")
        if start in VOID:
            continue
        words, label, unseen = _attributes(m.group(3)) if m.group(3) and not m.group(3).isspace() else ([], -1, False)
        own = stack[-1][1]
        if start in BLOCKS or start in CONTROLS or words or label >= 0:
            own = node(start, words, label)
        if m.group(3) and m.group(3).endswith("/") and start in HIDDEN:
            continue
        if start in BLOCKS:
            blocks.append(len(stack))
            inline.append(Counter())
        else:
            inline[-1][start] += 1
        if start in CHOICES:
            choices.append(len(stack))
        opened[start] += 1
        stack.append(("#hidden" if unseen and start in BLOCKS else start, own))
        links += start == "a"
        hidden += start in HIDDEN or (unseen and start in BLOCKS)
        if start in RAW:
            stop = re.compile(rf"</{re.escape(start)}(?=[\s/>]|\Z)", re.I).search(source, at)
            stop_at = stop.start() if stop else len(source)
            text(source[at:stop_at])
            at = stop_at
    return page
