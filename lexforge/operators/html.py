"""Crawled pages to Markdown: furniture removal, choice of the main container, conversion.

``strip_tags_sql`` and ``body_sql`` are column expressions for whole-table scans; ``page_to_markdown`` walks the parsed page
for containers that nest, in Arrow batches.
"""

from __future__ import annotations

import re
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements removed with all they hold.
FURNITURE = ("script", "style", "nav", "footer", "header", "noscript", "button", "iframe")
#: Containers of the law text, best first; the body comes last.
CONTAINERS = (("class", "fulltext"), ("id", "toanvancontent"), ("class", "content"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def furniture_patterns() -> list[str]:
    return [rf"(?is)<{tag}\b.*?</{tag}\s*>" for tag in FURNITURE]


BODY = r"(?is)<body\b[^>]*>(.*)"


def strip_furniture(c: Column) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, p, ""), furniture_patterns(), c)


def body_of(c: Column) -> Column:
    """What follows the body tag; empty without one. The end tag is often missing and isn't needed."""
    return F.regexp_extract(c, BODY, 1)


class _Page(HTMLParser):
    """The page as a light tree of [tag, attributes, children]; unclosed elements end with their parent."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ["", {}, []]
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        node = [tag, {k: v or "" for k, v in attrs}, []]
        self.stack[-1][2].append(node)
        if tag not in _VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.stack[-1][2].append([tag, dict(attrs), []])

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        self.stack[-1][2].append(data)


def _nodes(root):
    todo = [root]
    while todo:
        n = todo.pop()
        yield n
        todo += [c for c in reversed(n[2]) if not isinstance(c, str)]


def _prune(root) -> None:
    for n in _nodes(root):
        n[2] = [c for c in n[2] if isinstance(c, str) or c[0] not in FURNITURE]


def main_container(root):
    for attr, word in CONTAINERS:
        for n in _nodes(root):
            if n[0] == "div" and (word in n[1].get("class", "").split() if attr == "class" else n[1].get("id") == word):
                return n
    return next((n for n in _nodes(root) if n[0] == "body"), None)


_SPACES = re.compile(r"[ \t\r\n\f]+")


def _render(root) -> str:
    out: list[str] = []
    # (node or closing text, list depth, ordered counter, preformatted)
    todo: list = [(root, 0, None, False)]
    while todo:
        n, depth, counter, pre = todo.pop()
        if isinstance(n, tuple):
            out.append(n[0])
            continue
        if isinstance(n, str):
            out.append(n if pre else _SPACES.sub(" ", n))
            continue
        tag, close = n[0], ""
        if re.fullmatch("h[1-6]", tag):
            out.append("\n\n" + "#" * int(tag[1]) + " ")
            close = "\n\n"
        elif tag in ("p", "div", "table", "section", "article", "blockquote", "dl"):
            out.append("\n\n")
            close = "\n\n"
        elif tag in ("ul", "ol"):
            depth, counter, close = depth + 1, [0] if tag == "ol" else None, "\n\n" if depth == 0 else ""
        elif tag == "li":
            if counter is not None:
                counter[0] += 1
            out.append("\n" + "  " * depth + (f"{counter[0]}. " if counter is not None else "* "))
        elif tag == "br":
            out.append("  \n")
        elif tag == "hr":
            out.append("\n\n* * *\n\n")
        elif tag == "tr":
            close = "\n"
        elif tag in ("td", "th"):
            close = " | "
        elif tag in ("b", "strong"):
            out.append("**")
            close = "**"
        elif tag in ("i", "em"):
            out.append("_")
            close = "_"
        elif tag == "pre":
            out.append("\n\n```\n")
            pre, close = True, "\n```\n\n"
        elif tag == "code" and not pre:
            out.append("`")
            close = "`"
        elif tag == "img":
            continue
        todo.append(((close,), 0, None, False))
        todo += [(c, depth, counter, pre) for c in reversed(n[2])]
    text = re.sub(r" *\n *(?=\n)", "\n", "".join(out)).replace("\xa0", " ")
    text = re.sub(r"\| *\n", "\n", re.sub(r"\n (?=[^ ])", "\n", text))
    return re.sub(r"\n{3,}", "\n\n", text).strip() + "\n"


def page_to_markdown(page: str | None) -> str | None:
    """Markdown of the main container: links as their text, images left out, lines not wrapped; empty without a container."""
    if page is None:
        return None
    p = _Page()
    p.feed(page)
    p.close()
    _prune(p.root)
    node = main_container(p.root)
    return "" if node is None else _render(node)


def _markdown_batch(pages: pd.Series) -> pd.Series:
    return pd.Series([page_to_markdown(x) for x in pages], dtype=object)


def to_markdown(c: Column) -> Column:
    return F.pandas_udf(_markdown_batch, "string")(c)
