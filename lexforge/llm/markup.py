"""Markup in text documents: what kinds a text holds, and the text without it but with its structure.

A text is parsed to a tree of nodes that may be markup (dom). Gradient-boosted trees score every node from its construct,
subtree density, attribute tokens, depth, siblings and surroundings; one set of trees tells the kind (none, html, markdown,
wiki, latex), another whether an element is page furniture. Decoding is hierarchical: over each tree the labelling of the
highest total score is chosen among those without contradictions - within a node that is no markup nothing is, within
dropped furniture nothing is kept. The trees are fitted on a bounded sample made by rule (samples.N_PROSE texts and
samples.N_PAGES pages), once in a driver.

Defined cases: null and empty texts hold no markup and clean to null and empty; what stands in script and style elements
is no markup; broken and unclosed tags count as tags; repeated rows give one result row; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm import dom, samples, trees
from lexforge.llm.blocks import by_chars
from lexforge.session import ship_package

_HTML_NODES = [dom.ID[k] for k in ("comment", "declaration", "raw", "tag", "closer", "broken")]


def _labelled_prose(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    parsed, labels = [], []
    for text, spans in samples.prose(n, seed):
        t = dom.parse(text)
        parsed.append(t)
        for s in t.start:
            labels.append(next((k for a, b, k in spans if a <= s < b), samples.NONE))
    return dom.features(parsed), np.array(labels)


def _labelled_pages(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    parsed, labels = [], []
    for text, spans in samples.pages(n, seed):
        t = dom.parse(text)
        parsed.append(t)
        labels += [int(any(a <= s < b for a, b in spans)) for s in t.start]
    return dom.features(parsed), np.array(labels)


@lru_cache(maxsize=1)
def models() -> tuple[trees.Boosted, trees.Boosted]:
    """The trees for kinds and for furniture, fitted once in a process."""
    x, y = _labelled_prose(samples.N_PROSE, 101)
    px, py = _labelled_pages(samples.N_PAGES, 202)
    x, y = np.concatenate([x, px]), np.concatenate([y, np.where(np.isin(px[:, 0], _HTML_NODES + [dom.ID["entity"]]), samples.HTML, samples.NONE)])
    return trees.fit(x, y, len(samples.KINDS)), trees.fit(px, py, 2, rounds=20)


def decode(parent: list[int], score: np.ndarray, barrier: int) -> np.ndarray:
    """The labels of the highest total score such that below a node labelled ``barrier`` all are."""
    n = len(parent)
    free = np.delete(score, barrier, axis=1)
    best_free, own = free.max(axis=1), score[:, barrier]
    all_barrier = own.copy()  # the subtree if all of it is barrier
    open_ = best_free.copy()  # the subtree if its root isn't
    best = np.zeros(n)
    for i in range(n - 1, -1, -1):
        best[i] = max(all_barrier[i], open_[i])
        p = parent[i]
        if p >= 0:
            all_barrier[p] += all_barrier[i]
            open_[p] += best[i]
    label = np.delete(np.arange(score.shape[1]), barrier)[free.argmax(axis=1)]
    for i in range(n):
        p = parent[i]
        if (p >= 0 and label[p] == barrier) or all_barrier[i] > open_[i]:
            label[i] = barrier
    return label


def classify(texts: list[str | None], both: tuple[trees.Boosted, trees.Boosted], furniture: bool) -> Iterator[tuple[dom.Tree, np.ndarray, np.ndarray | None]]:
    """Tree, kinds and (with ``furniture``) whether each node is dropped, for each text."""
    parsed = [dom.parse(t or "") for t in texts]
    x = dom.features(parsed)
    if not len(x):
        yield from ((t, np.zeros(0, np.int64), np.zeros(0, np.int64)) for t in parsed)
        return
    kind = both[0].scores(x)
    drop = both[1].scores(x) if furniture else None
    at = 0
    for t in parsed:
        n = len(t.kind)
        k = decode(t.parent, kind[at : at + n], samples.NONE)
        d = None
        if furniture:
            s = drop[at : at + n].copy()
            for i in range(n):  # only elements can be furniture; others follow them
                if t.kind[i] not in _HTML_NODES:
                    s[i] = (0.0, 0.0)
            d = decode(t.parent, s, 1)
        at += n
        yield t, k, d


_CELLS = re.compile(r"\s*(?:\|\||!!|\|)\s*")
_ARG = re.compile(r"\{([^{}]*)\}")
_ENV = re.compile(r"\\begin[ \t]*\{([A-Za-z]+\*?)\}")
_TAGS = re.compile(r"</?[A-Za-z][^<>]*>")
_HELD = re.compile("\ue000([0-9]+)\ue001")

# LaTeX environments that hold a formula, those that hold literal text, commands that belong to formulas, levels of headings.
FORMULAS = frozenset("equation align gather multline eqnarray displaymath math flalign alignat".split())
LITERAL = frozenset("verbatim Verbatim lstlisting minted".split())
FORMULA_COMMANDS = frozenset("frac sqrt sum int prod cdot times div pm le ge leq geq neq approx infty partial alpha beta gamma delta epsilon theta lambda mu pi rho sigma tau phi omega Delta Sigma Omega".split())
LEVELS = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}
#: Elements of literal text.
CODE = frozenset("pre code kbd samp tt".split())


class _MathReader(HTMLParser):
    """MathML as nested lists [name, child, ...]."""

    def __init__(self, text: str):
        super().__init__(convert_charrefs=True)
        self.stack: list[list] = [["math"]]
        self.feed(text)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag.split(":")[-1]]
        self.stack[-1].append(node)
        self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.stack[-1].append([tag.split(":")[-1]])

    def handle_endtag(self, tag):
        name = tag.split(":")[-1]
        if any(n[0] == name for n in self.stack[1:]):
            while self.stack.pop()[0] != name:
                pass

    def handle_data(self, data):
        if data.strip():
            self.stack[-1].append(data.strip())


def _formula(node) -> str:
    if isinstance(node, str):
        return node
    kids = [k for k in map(_formula, node[1:]) if k]
    group = [k if len(k) == 1 else "{" + k + "}" for k in kids]
    if node[0] in ("annotation", "annotation-xml"):
        return ""
    if node[0] == "mfrac" and len(kids) == 2:
        return rf"\frac{{{kids[0]}}}{{{kids[1]}}}"
    if node[0] in ("msqrt", "mroot") and kids:
        return rf"\sqrt[{kids[1]}]{{{kids[0]}}}" if node[0] == "mroot" and len(kids) == 2 else rf"\sqrt{{{' '.join(kids)}}}"
    if node[0] in ("msup", "mover") and len(kids) == 2:
        return f"{group[0]}^{group[1]}"
    if node[0] in ("msub", "munder") and len(kids) == 2:
        return f"{group[0]}_{group[1]}"
    if node[0] in ("msubsup", "munderover") and len(kids) == 3:
        return f"{group[0]}_{group[1]}^{group[2]}"
    return {"mtr": " & ", "mtable": r" \\ "}.get(node[0], " ").join(kids)


def mathml(text: str) -> str:
    """A MathML element as a formula between dollars."""
    body = _formula(_MathReader(text).stack[0])
    return f"${body}$" if body else ""


def _closing(text: str, at: int) -> int:
    """The place of the brace that closes the one at ``at`` (-1: there is none)."""
    depth = 0
    for m in re.finditer(r"[{}]", text[at:]):
        depth += 1 if m.group() == "{" else -1
        if depth == 0:
            return at + m.start()
    return -1


def _template(body: str) -> str:
    """What a wiki template says: its values; a name alone is no text."""
    values = [x.strip() for x in body[2:-2].split("|")[1:]]
    return " ".join(x.split("=", 1)[-1].strip() for x in values)


def _edits(t: dom.Tree, kinds: np.ndarray, drop: np.ndarray | None, hold) -> list[tuple[int, int, str]]:
    """(start, end, what stands there instead), in order and apart; ``hold`` takes literal text and gives what stands for it until the end."""
    out: list[tuple[int, int, str]] = []
    text, skip, counted = t.text, -1, {}
    for i in range(len(t.kind)):
        s, e, o, c, k = t.start[i], t.end[i], t.open_end[i], dom.CONSTRUCTS[t.kind[i]], kinds[i]
        if s < skip:
            continue
        if c == "tag" and t.close[i] and t.name[i].split(":")[-1] == "math":
            out.append((s, e, hold(mathml(text[s:e]))))
            skip = e
            continue
        if c in ("comment", "declaration", "raw") or (drop is not None and drop[i] and c in ("tag", "broken", "closer") and (t.name[i] in dom.FURNITURE or t.close[i] is not None)):
            out.append((s, e, " " if c == "comment" else "\n"))
            skip = e
            continue
        if k == samples.NONE:
            continue
        body, name = text[s:e], t.name[i]
        if c in ("tag", "broken", "closer"):
            pre, post = "", ""
            if c == "tag" and name in CODE and t.close[i]:
                inner = html.unescape(_TAGS.sub("", text[o : t.close[i][0]])).replace("\xa0", " ")
                out.append((s, e, "\n" + hold("```\n" + inner.strip("\n") + "\n```") + "\n" if name == "pre" else hold(inner)))
                skip = e
                continue
            if name in dom.HEADINGS:
                pre, post = "\n\n" + "#" * int(name[1]) + " ", "\n\n"
            elif name == "li":
                p = t.parent[i]
                if p >= 0 and t.name[p] == "ol" and c != "closer":
                    counted[p] = counted.get(p, 0) + 1
                    pre = f"\n{counted[p]}. "
                else:
                    pre = "\n- "
            elif name in ("td", "th"):
                pre, post = "", " | "
            elif name == "pre":
                pre, post = "\n```\n", "\n```\n"
            elif name in ("sup", "sub"):
                pre = "^" if name == "sup" else "_"
            elif name == "img":
                m = re.search(r"alt\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", body)
                pre = next((g for g in m.groups() if g), "") if m else ""
            elif name in dom.BLOCK or name in ("br", "tr", "table", "ul", "ol"):
                pre = post = "\n"
            out.append((s, o, pre if c != "closer" else post))
            if t.close[i]:
                out.append((*t.close[i], post))
        elif c == "entity":
            out.append((s, e, html.unescape(body).replace("\xa0", " ")))
        elif c in ("md_bold", "md_strike", "md_em", "wk_bold"):
            n = 2 if c in ("md_bold", "md_strike") else 1 if c == "md_em" else (len(body) - len(body.lstrip("'")))
            out += [(s, s + n, ""), (e - n, e, "")]
        elif c in ("md_link", "md_image"):
            cut = s + body.index("](")
            out += [(s, s + (2 if c == "md_image" else 1), ""), (cut, e, "")]
        elif c == "code":
            n = len(body) - len(body.lstrip("`"))
            out.append((s, e, hold(body[n:-n] if len(body) > 2 * n else "")))
            skip = e
        elif c == "md_bullet":
            at = s + len(body) - len(body.lstrip())
            out.append((at, at + 1, "-"))
        elif c == "md_quote":
            out.append((s, e, ""))
        elif c == "md_hr" and body.strip()[0] in "=-" and _title_before(text, s) is not None:
            at = _title_before(text, s)
            out += [(at, at, "# " if body.strip()[0] == "=" else "## "), (s, e, "")]
            skip = e
        elif c in ("md_rule", "md_hr", "wk_table", "wk_end", "wk_sep", "wk_magic"):
            out.append((s, e, ""))
            skip = e
        elif c in ("md_row", "wk_cells", "wk_cap"):
            out.append((s, e, " | ".join(x for x in _CELLS.split(body.strip().strip("|!").strip()))))
            skip = e
        elif c == "wk_head":
            n = len(body) - len(body.lstrip("="))
            right = len(body.rstrip()) - n
            out += [(s, s + n, "#" * n), (s + right, e, "")]
        elif c == "wk_link":
            inside = body[2:-2]
            out.append((s, e, "" if re.match(r"(?:Thể loại|Category|Tập tin|File|Image|Hình):", inside, re.I) else inside.rsplit("|", 1)[-1]))
            skip = e
        elif c == "wk_template":
            out.append((s, e, _template(body)))
            skip = e
        elif c == "tx_env":
            m = _ENV.match(body)
            plain = m.group(1).rstrip("*") if m else ""
            if plain in FORMULAS or plain in LITERAL:
                end = re.compile(r"\\end[ \t]*\{" + re.escape(m.group(1)) + r"\}").search(text, s + m.end())
                last, after = (end.start(), end.end()) if end else (len(text), len(text))
                if plain in LITERAL:
                    out.append((s, after, "\n" + hold("```\n" + text[e:last].strip("\n") + "\n```") + "\n"))
                elif plain in ("equation", "displaymath", "math"):
                    out.append((s, after, hold("$$" + text[s + m.end() : last] + "$$")))
                else:  # rows and columns mean something only in their environment
                    out.append((s, after, hold("$$" + text[s:after] + "$$")))
                skip = after
            else:
                out.append((s, e, ""))
        elif c == "tx_break":
            out.append((s, e, ""))
        elif c == "tx_command":
            args, cmd = _ARG.findall(body), re.match(r"\\([A-Za-z]+)", body).group(1)
            if cmd in FORMULA_COMMANDS:
                skip = e
                continue
            level = LEVELS.get(cmd)
            if not args and cmd != "item" and text[e : e + 1] == "{" and (last := _closing(text, e)) > 0:
                # braces within its argument: what is there comes on its own
                out += [(s, e + 1, "#" * level + " " if level else " (" if cmd == "footnote" else ""), (last, last + 1, ")" if cmd == "footnote" else "")]
                continue
            arg = args[-1] if args else ""
            got = f"{'#' * level} {arg}" if level else "- " if cmd == "item" else f" ({arg})" if cmd in ("footnote", "ref", "cite") else arg
            out.append((s, e, got + (body[5:] if cmd == "item" else "")))
            skip = e
        elif c == "amp":
            out.append((s, e, "|"))
    return out


def _title_before(text: str, s: int) -> int | None:
    """The start of the line before ``s`` if it can be a heading that the line at ``s`` underlines."""
    if s < 2 or text[s - 1] != "\n":
        return None
    at = text.rfind("\n", 0, s - 1) + 1
    line = text[at : s - 1].strip()
    return at if line and line[0] not in "#>|-*+=`" else None


def clean(t: dom.Tree, kinds: np.ndarray, drop: np.ndarray | None, hold=str) -> str:
    """The text without its markup: headings as '#' lines, lists as '- ' or numbered lines, table cells between '|', code fenced, formulas as they are."""
    out, at = [], 0
    for s, e, new in sorted(_edits(t, kinds, drop, hold), key=lambda x: (x[0], x[1])):
        if s < at:
            continue
        out += [t.text[at:s], new]
        at = e
    out.append(t.text[at:])
    s = re.sub(r"[ \t]+\n", "\n", re.sub(r"(?: \| )+(?=\n|$)", "", "".join(out)))
    return re.sub(r"\n{3,}", "\n\n", s).strip()


_ESCAPED = re.compile(r"&(?:lt|#60|#x3[cC]);[/!]?[A-Za-z]")


def _clean_all(texts: list[str | None], both: tuple[trees.Boosted, trees.Boosted]) -> list[str]:
    """Clean texts; those with escaped tags twice, as the first pass brings the tags out. Code and formulas are set aside meanwhile."""
    held: list[str] = []

    def hold(s: str) -> str:
        held.append(s)
        return f"\ue000{len(held) - 1}\ue001"

    def pass_(which: list[str | None]) -> list[str]:
        return [clean(t, k, d, str if "\ue000" in (w or "") and own else hold) for w, (t, k, d) in zip(which, classify(which, both, True))]

    own = True  # a text that has the mark itself keeps its code in place
    out = pass_(texts)
    again = [i for i, t in enumerate(texts) if _ESCAPED.search(t or "")]
    own = False
    for i, s in zip(again, pass_([out[i] for i in again])):
        out[i] = s
    for i, t in enumerate(texts):
        while "\ue000" not in (t or "") and "\ue000" in out[i]:
            out[i] = _HELD.sub(lambda m: held[int(m.group(1))], out[i])
    return out


def found_kinds(records: DataFrame) -> DataFrame:
    """(source_table, record_key, markup): kinds of markup in ``records`` (source_table, record_key, text)."""
    ship_package(records.sparkSession)
    held = records.sparkSession.sparkContext.broadcast(models())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            texts, index, names = rb.column("text").to_pylist(), [], []
            for lo, hi in by_chars(texts):
                for i, (_, kinds, _) in enumerate(classify(texts[lo:hi], held.value, False), lo):
                    for k in np.unique(kinds):
                        if k != samples.NONE:
                            index.append(i)
                            names.append(samples.KINDS[k])
            i = pa.array(index, pa.int64())
            yield pa.RecordBatch.from_arrays([rb.column("source_table").take(i), rb.column("record_key").take(i), pa.array(names, pa.string())], names=["source_table", "record_key", "markup"])

    # a text without any of these symbols has no node
    some = records.where(F.col("record_key").isNotNull() & F.col("text").rlike(dom.SYMBOLS))
    return some.mapInArrow(run, "source_table string, record_key string, markup string").distinct()


def clean_texts(records: DataFrame) -> DataFrame:
    """(source_table, record_key, clean_text, n_removed): every record's text without markup and furniture; texts without symbols pass in the JVM."""
    ship_package(records.sparkSession)
    held = records.sparkSession.sparkContext.broadcast(models())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            texts, out = rb.column("text").to_pylist(), []
            for lo, hi in by_chars(texts):
                out += _clean_all(texts[lo:hi], held.value)
            removed = [len(a) - len(b) for a, b in zip(texts, out)]
            yield pa.RecordBatch.from_arrays([rb.column("source_table"), rb.column("record_key"), pa.array(out, pa.string()), pa.array(removed, pa.int64())], names=["source_table", "record_key", "clean_text", "n_removed"])

    has = F.coalesce(F.col("text").rlike(dom.SYMBOLS), F.lit(False))
    plain = records.where(~has).select("source_table", "record_key", F.trim("text").alias("clean_text"), (F.length("text") - F.length(F.trim("text"))).cast("long").alias("n_removed"))
    return records.where(has).mapInArrow(run, "source_table string, record_key string, clean_text string, n_removed long").unionByName(plain)
