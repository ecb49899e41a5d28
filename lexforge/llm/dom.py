"""Texts as trees of nodes that may be markup: HTML elements, and the constructs of Markdown, wiki and LaTeX around and in them.

Every stretch that could be markup becomes a node, also bare symbols of ordinary prose; what it is, the trees decide (see
markup). A node's children are the nodes within it. HTML elements are closed as browsers do in the main: a closing tag ends
the nearest open element of its name, void elements hold nothing, a block ends an open paragraph.
"""

from __future__ import annotations

import re

import numpy as np

# Order matters twice: earlier alternatives win at the same place, and neighbours in this list are of one family.
CONSTRUCTS = (
    "comment", "declaration", "raw", "tag", "closer", "broken", "entity", "lt", "amp",
    "fence", "code", "md_image", "md_link", "md_bold", "md_strike", "md_em", "md_head", "md_rule", "md_row", "md_hr", "md_quote", "md_bullet",
    "wk_table", "wk_end", "wk_sep", "wk_cap", "wk_cells", "wk_link", "wk_template", "wk_bold", "wk_head", "wk_magic",
    "path", "tx_env", "tx_display", "tx_inline", "tx_dollar2", "tx_dollar", "tx_command", "tx_break",
    "hash", "bracket", "brace", "star", "tilde", "pipe", "dollar", "score", "quotes", "backslash",
)
ID = {c: i for i, c in enumerate(CONSTRUCTS)}

_RULES = [
    ("comment", r"<!--[\s\S]*?(?:-->|\Z)"),
    ("declaration", r"<(?:![A-Za-z\[]|\?)[^>]*>?"),
    ("raw", r"<(?P<rawname>[sS][cC][rR][iI][pP][tT]|[sS][tT][yY][lL][eE])\b[^>]*>[\s\S]*?(?:</(?P=rawname)\s*>|\Z)"),
    ("tag", r"<[A-Za-z][A-Za-z0-9:-]*(?:[\s/][^<>]*)?>"),
    ("closer", r"</[A-Za-z][A-Za-z0-9:-]*\s*>"),
    ("broken", r"</?[A-Za-z][A-Za-z0-9:-]*(?:\s+[^<>\n]*)?"),
    ("lt", r"<"),
    ("entity", r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"),
    ("amp", r"&\w*"),
    ("fence", r"^[ \t]*(?P<tick>```+|~~~+)[^\n`]*\n[\s\S]*?(?:^[ \t]*(?P=tick)[ \t]*$|\Z)"),
    ("code", r"(?P<t2>`+)[^`\n]+(?P=t2)|`{3,}"),
    ("md_rule", r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$|^[ \t]*\|[ \t]*:?-{3,}:?[ \t]*\|[ \t]*$"),
    ("wk_table", r"^[ \t]*\{\|[^\n]*"),
    ("wk_end", r"^[ \t]*\|\}"),
    ("wk_sep", r"^[ \t]*\|-+[^\n|]*$"),
    ("wk_cap", r"^[ \t]*(?:!|\|\+)[^\n!\[][^\n]*$"),
    ("wk_cells", r"^[ \t]*\|[^\n|]*\|\|[^\n]*$"),
    ("md_row", r"^[ \t]*\|[^\n]*\|[ \t]*$"),
    ("wk_template", r"\{\{[^{}]*\}\}"),
    ("wk_link", r"\[\[[^\[\]\n]*\]\]"),
    ("wk_head", r"^(?P<eq>={1,6})[^=\n]+(?P=eq)[ \t]*$"),
    ("wk_magic", r"__[A-Z]{3,}__|^#(?:REDIRECT|redirect)\b"),
    ("wk_bold", r"(?P<q>'{2,5})(?=[^'\s])[^'\n]*(?P=q)"),
    ("md_image", r"!\[[^\[\]\n]*\]\([^()\n]*\)"),
    ("md_link", r"\[[^\[\]\n]+\]\([^()\n]*\)"),
    ("md_bold", r"\*\*(?=[^\s*])[^*\n]*\*\*|__(?=[^\s_])[^_\n]*__"),
    ("md_strike", r"~~(?=[^\s~])[^~\n]*~~"),
    ("md_hr", r"^[ ]{0,3}(?:-{3,}|\*{3,}|_{3,}|={3,})[ \t]*$"),
    ("md_bullet", r"^[ \t]*[*+][ \t]+(?=\S)"),
    ("md_em", r"\*(?=[^\s*])[^*\n]*[^\s*]\*"),
    ("md_head", r"^[ ]{0,3}#{1,6}[ \t]+(?=\S)"),
    ("md_quote", r"^[ ]{0,3}>[ \t]?"),
    ("path", r"(?<=[A-Za-z]):\\[^\s<>|]*"),
    ("tx_env", r"\\(?:begin|end)[ \t]*\{[A-Za-z*]+\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?"),
    ("tx_display", r"\\\[(?:(?!\\\[)[\s\S])*?\\\]"),
    ("tx_inline", r"\\\([^\n]*?\\\)"),
    ("tx_dollar2", r"\$\$[^$]+\$\$"),
    ("tx_dollar", r"\$(?=[^\s$])[^$\n]*?[^\s$\\]\$(?!\d)"),
    ("tx_command", r"\\[A-Za-z]{2,}\*?(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})*"),
    ("tx_break", r"\\\\"),
    ("hash", r"#+"),
    ("bracket", r"\[[^\[\]\n]*\]"),
    ("brace", r"\{[^{}\n]*\}"),
    ("star", r"\*+"),
    ("tilde", r"~+"),
    ("pipe", r"\|+"),
    ("dollar", r"\$+"),
    ("score", r"_+\w*"),
    ("quotes", r"'{2,}"),
    ("backslash", r"\\+"),
]
# nodes begin with a symbol, some only at the start of a line; other places fail at the first look
SCAN = re.compile(r"(?=[<&`#*_~|\[\]{}\\$'!:]|^[ \t>=+\-])(?:" + "|".join(f"(?P<{n}>{p})" for n, p in _RULES) + ")", re.M)
#: What a text must hold to have any node; tested in the JVM before a text leaves it.
SYMBOLS = r"[<&`#*_~|\[\]{}\\$]|''|(?m:^\s*(?:>|-{3,}\s*$|={1,6}|\+\s|!))"
_RESCAN = {"md_bold", "md_strike", "md_em", "md_link", "wk_bold", "wk_head", "md_row", "wk_cells", "wk_cap", "wk_link", "bracket", "brace", "wk_template", "tx_command"}
_EDGE = {"md_bold": 2, "md_strike": 2, "md_em": 1, "md_link": 1, "wk_bold": 2, "wk_head": 1, "md_row": 1, "wk_cells": 1, "wk_cap": 1, "wk_link": 2, "bracket": 1, "brace": 1, "wk_template": 2, "tx_command": 1}

# Element names by the part they play.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd div dl dt fieldset figcaption figure footer form header hr html main nav p section".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TABLE = frozenset("table thead tbody tfoot tr td th caption".split())
LISTS = frozenset("ul ol li".split())
INLINE = frozenset("a abbr b big br cite code del dfn em font i img ins kbd mark pre q s samp small span strike strong sub sup tt u var".split())
FURNITURE = frozenset("nav footer header aside script style noscript button iframe form input select option label svg canvas template title head meta link".split())
_CLOSES_P = BLOCK | HEADINGS | {"table", "ul", "ol", "pre"}
_SAME = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
_ATTR = re.compile(r"[\w:-]+\s*=")
_LAYOUT = re.compile(r"nav|menu|footer|header|banner|cookie|breadcrumb|sidebar|share|advert|button|toolbar|login|search|copyright", re.I)
_CONTENT = re.compile(r"content|fulltext|toanvan|article|main|body|text|noidung|chitiet|khoan|dieu|normal", re.I)


class Tree:
    """Nodes of one text: constructs, spans, parents, ends of subtrees."""

    __slots__ = ("text", "kind", "start", "end", "open_end", "parent", "close", "name")

    def __init__(self, text: str):
        self.text = text
        self.kind: list[int] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self.open_end: list[int] = []
        self.parent: list[int] = []
        self.close: list[tuple[int, int] | None] = []
        self.name: list[str] = []

    def add(self, kind: str, start: int, end: int, parent: int, name: str = "") -> int:
        self.kind.append(ID[kind])
        self.start.append(start)
        self.end.append(end)
        self.open_end.append(end)
        self.parent.append(parent)
        self.close.append(None)
        self.name.append(name)
        return len(self.kind) - 1


def parse(text: str) -> Tree:
    """The nodes of a text; its line ends become line feeds."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    t = Tree(text)
    _scan(t, text, 0, len(text), -1, [])
    return t


def _scan(t: Tree, text: str, lo: int, hi: int, outer: int, stack: list[int]) -> None:
    base = len(stack)
    for m in SCAN.finditer(text, lo, hi):
        kind = m.lastgroup
        if kind in ("rawname", "tick", "t2", "eq", "q"):
            kind = next(k for k in ("raw", "fence", "code", "wk_head", "wk_bold") if m.group(k) is not None)
        s, e = m.span()
        parent = stack[-1] if len(stack) > base else outer
        if kind == "tag":
            name = _NAME.match(m.group()).group(1).lower()
            while len(stack) > base:
                top = t.name[stack[-1]]
                if (top == "p" and name in _CLOSES_P) or (name in _SAME and top in _SAME[name]):
                    t.end[stack.pop()] = s
                else:
                    break
            parent = stack[-1] if len(stack) > base else outer
            i = t.add(kind, s, e, parent, name)
            if name not in VOID and not m.group().endswith("/>"):
                stack.append(i)
        elif kind == "closer":
            name = _NAME.match(m.group()).group(1).lower()
            k = len(stack) - 1
            while k >= base and t.name[stack[k]] != name:
                k -= 1
            if k < base:
                t.add(kind, s, e, parent, name)
            else:
                for j in stack[k:]:
                    t.end[j] = s
                t.end[stack[k]], t.close[stack[k]] = e, (s, e)
                del stack[k:]
        else:
            i = t.add(kind, s, e, parent, m.group("rawname").lower() if kind == "raw" else _NAME.match(m.group()).group(1).lower() if kind == "broken" else "")
            if kind in _RESCAN and e - s > 2 * _EDGE[kind]:
                _scan(t, text, s + _EDGE[kind], e - _EDGE[kind] if kind not in ("md_row", "wk_cells", "wk_cap", "tx_command") else e, i, [])
    while len(stack) > base:
        t.end[stack.pop()] = hi


_CLASS = np.full(0x10000, 4, dtype=np.int8)
for _c in range(0x10000):
    _ch = chr(_c)
    _CLASS[_c] = 1 if _ch.isspace() else 2 if _ch.isdigit() else 3 if _ch.isalpha() else 4
_GROUP = {}
for _g, _names in ((1, BLOCK), (2, INLINE), (3, HEADINGS), (4, TABLE), (5, LISTS), (6, FURNITURE)):
    for _n in _names:
        _GROUP[_n] = _g

FEATURES = (
    "construct", "length", "inner_words", "has_digit", "has_letter", "inner_left_space", "inner_right_space", "line_start", "line_end", "before", "after",
    "closed", "depth", "siblings", "place", "subtree_nodes", "subtree_density", "attributes", "layout_token", "content_token", "tag_group", "alike", "operators",
    "parent_construct", "link_density", "parent_group",
)
_DIGIT, _LETTER = re.compile(r"\d"), re.compile(r"[^\W\d_]")
_OPERATOR = re.compile(r"[\\^_={}+]|\\[a-z]")


def features(trees: list[Tree]) -> np.ndarray:
    """[nodes of all trees, features]"""
    rows: list[tuple] = []
    for t in trees:
        text, n, total = t.text, len(t.kind), len(t.text)
        depth, size, links, children, place = [0] * n, [1] * n, [0] * n, [0] * n, [0] * n
        roots = 0
        alike: dict[int, int] = {}
        for i in range(n):
            p = t.parent[i]
            if p >= 0:
                depth[i] = depth[p] + 1
                place[i] = children[p]
                children[p] += 1
            else:
                place[i] = roots
                roots += 1
            alike[t.kind[i]] = alike.get(t.kind[i], 0) + 1
        for i in range(n - 1, -1, -1):
            p = t.parent[i]
            if p >= 0:
                size[p] += size[i]
                links[p] += links[i] + (t.end[i] - t.start[i] if t.name[i] == "a" else 0)
        for i in range(n):
            s, e, o, p, k = t.start[i], t.end[i], t.open_end[i], t.parent[i], t.kind[i]
            head = text[s:o]
            inner = head.strip("*_~`'=|[]{}$#<>/\\!&;()")
            before = 0 if s == 0 else int(_CLASS[min(ord(text[s - 1]), 0xFFFF)])
            after = 0 if o >= total else int(_CLASS[min(ord(text[o]), 0xFFFF)])
            is_tag = k in (3, 5)
            attrs = layout = content = 0
            if is_tag and o - s > len(t.name[i]) + 3:
                attrs = len(_ATTR.findall(head))
                if attrs:
                    layout, content = _LAYOUT.search(head) is not None, _CONTENT.search(head) is not None
            span = e - s
            rows.append((
                k, min(o - s, 400), min(inner.count(" ") + 1 if inner else 0, 60), _DIGIT.search(head) is not None, _LETTER.search(head) is not None,
                inner[:1].isspace(), inner[-1:].isspace(), s == 0 or text[s - 1] == "\n", o >= total or text[o] == "\n", before, after,
                t.close[i] is not None, min(depth[i], 12), min(children[p] if p >= 0 else roots, 60), min(place[i], 60), min(size[i], 200), min(span / size[i], 2000.0), attrs, layout, content,
                _GROUP.get(t.name[i], 7) if t.name[i] else 0, min(alike[k], 30), len(_OPERATOR.findall(head)) if not is_tag else 0,
                t.kind[p] if p >= 0 else -1, links[i] / span if span else 0, _GROUP.get(t.name[p], 7) if p >= 0 and t.name[p] else 0,
            ))
    return np.array(rows, dtype=np.float32).reshape(-1, len(FEATURES))
