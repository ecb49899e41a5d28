"""Labelled examples for the markup trees, made by rule from a seed: prose with markup of known kinds, prose with bare symbols, pages.

The number of examples is the bound of the training sample. Each example is a text with labelled spans; a node of the parsed
text takes the label of the innermost span that holds its start, none without one.
"""

from __future__ import annotations

import random

NONE, HTML, MARKDOWN, WIKI, LATEX = range(5)
KINDS = ("none", "html", "markdown", "wiki", "latex")
#: Examples of prose and of pages to fit on.
N_PROSE, N_PAGES = 1_600, 160

_SYLLABLES = "xe tải phải dừng trước vạch sơn khi đèn đỏ theo quy định của cơ quan quản lý đường bộ người lái có giấy phép được hạng số khoản điều mức phạt đồng từ đến trong vùng đô thị hành khách the driver must stop at line when road signs show".split()


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, lo: int = 1, hi: int = 6) -> str:
        w = [self.r.choice(_SYLLABLES) for _ in range(self.r.randint(lo, hi))]
        if self.r.random() < 0.2:
            w[self.r.randrange(len(w))] = str(self.r.randint(1, 9999))
        return " ".join(w)

    def sentence(self) -> str:
        w = self.words(5, 18)
        return w[0].upper() + w[1:] + self.r.choice([".", ".", ";", ",", ""])

    def number(self) -> int:
        return self.r.choice([self.r.randint(1, 20), self.r.randint(1, 999), self.r.randint(1000, 99999)])

    def name(self) -> str:
        return self.r.choice(["p", "div", "span", "b", "i", "em", "strong", "u", "font", "center", "h1", "h2", "h3", "h4", "h5", "li", "ul", "td", "tr", "table", "a", "sup", "sub", "pre", "code", "blockquote", "section", "o:p", "th", "small", "tbody"])

    def attrs(self) -> str:
        return self.r.choice(["", "", f' class="{self.r.choice(["MsoNormal", "khoan", "text", "a1", "bold"])}"', f' style="margin:{self.number()}px"', " align=center", f' href="https://example.org/x?id={self.number()}&amp;p=1"', " border=1 width=50%"])

    def html(self) -> tuple[str, bool]:
        n, r = self.name(), self.r
        w, a = self.words(1, 8), self.attrs()
        return r.choice([
            (f"<{n}{a}>{w}</{n}>", False), (f"<{n}{a}>{w}</{n}>", False), (f"<{n.upper()}{a}>{w}</{n.upper()}>", False), (f"<{n}{a}>{w}", False), (f"{w}</{n}>", False), ("<br>", False), ("<br/>", False), ("<hr />", False),
            (f"<!-- {w} -->", False), (f'<img src="{r.choice(["a.png", "dau.png"])}" alt={r.choice(_SYLLABLES)}>', False), (f"<ul><li>{w}</li><li>{self.words()}</li></ul>", False), (f"<table><tr><td>{w}</td><td>{self.number()}</td></tr></table>", False),
            (w.replace(" ", "&nbsp;"), False), (r.choice(["&amp;", "&lt;", "&gt;", "&quot;", "&ndash;", "&Agrave;", "&#7879;", "&#160;", "&#x1EC7;", "&ocirc;"]), False), (f"&lt;{n}&gt;{w}&lt;/{n}&gt;", False),
            (f"<{n}{a or ' class=x'}", True), (f"<script>var {r.choice('abp')} = $('#n').val(); if (p < {self.number()}) {{ q = '$' + p; }}</script>", False), ("<style>.a{color:#333} /* ** */</style>", False), (f"km<sup>{r.randint(2, 3)}</sup>", False),
        ])

    def markdown(self) -> tuple[str, bool]:
        r, w = self.r, self.words(1, 5)
        rows = "\n".join(f"| {self.words(1, 2)} | {self.number()} |" for _ in range(r.randint(1, 3)))
        return r.choice([
            (f"{'#' * r.randint(1, 6)} {w}", True), (f"{'#' * r.randint(1, 6)} Điều {self.number()}", True), (f"**{w}**", False), (f"__{w}__", False), (f"*{w}*", False), (f"~~{w}~~", False), (f"~~- {w}~~", False), (f"`{r.choice(_SYLLABLES)}`", False), (f"`{r.choice('abcd')})`", False), (f"`{w}`", False),
            (f"[{w}](https://example.org/{self.number()})", False), (f"![{w}](hinh_{self.number()}.png)", False), (f"```{r.choice(['', 'json', 'text'])}\nkey_{r.choice('ab')}: {self.number()}\n  lan: 2\n```", True),
            (f"| {self.words(1, 2)} | {self.words(1, 2)} |\n|{r.choice(['---|---', '---|:---:', ':--- | ---:'])}|\n{rows}", True), (f"\n{r.choice(['---', '***', '___', '-----'])}\n", True), (f"> {w}", True), (f"* {w}\n* {self.words()}", True), (f"+ {w}\n+ {self.words()}", True), (f"**{self.number()}. {w}**", False),
        ])

    def wiki(self) -> tuple[str, bool]:
        r, w = self.r, self.words(1, 4)
        q = "=" * r.randint(2, 5)
        return r.choice([
            (f"{q} {w} {q}", True), (f"'''{w}'''", False), (f"''{w}''", False), (f"'''- {w}'''", False), (f"[[{w}]]", False), (f"[[{w}|{self.words(1, 2)}]]", False), (f"[[Thể loại:{w}]]", False), (f"[[Tập tin:{r.choice(_SYLLABLES)}.png|nhỏ|{w}]]", False),
            (f"{{{{{w}|trang={self.number()}}}}}", False), (f"{{{{{w}}}}}", False), (f'{{| class="bang"\n! {self.words(1, 2)} !! {self.words(1, 2)}\n|-\n| {w} || {self.number()}\n|-\n| B || 2\n|}}', True), ("__TOC__", False),
        ])

    def latex(self) -> tuple[str, bool]:
        r, w, k = self.r, self.words(1, 4), self.number()
        f = r.choice([r"v \le %d" % k, r"a^2 + b^2 = c^2", r"\frac{v^2}{2 \cdot %d}" % k, r"x_{1} = %d" % k, r"\alpha", "v_0 t", "S = v t", "x", r"\sum_{i=1}^{n} x_i"])
        env = r.choice(["equation", "align*", "gather"])
        return r.choice([
            (f"${f}$", False), (f"$$ {f} $$", False), (f"\\[ S = {f} \\]", False), (f"\\( {f} \\)", False), (f"\\{r.choice(['section', 'subsection', 'paragraph*', 'chapter'])}{{{w}}}", True), (f"\\{r.choice(['textbf', 'emph', 'textit', 'underline'])}{{{w}}}", False),
            (f"\\footnote{{{w}.}}", False), (f"\\begin{{itemize}}\n\\item {w}\n\\item {self.words()}\n\\end{{itemize}}", True), (f"\\begin{{tabular}}{{ll}}\nA & {k} \\\\\nB & 2 \\\\\n\\end{{tabular}}", True), (f"\\begin{{{env}}}\n{f}\n\\end{{{env}}}", True), (f"\\begin{{verbatim}}\n{w} {k}\n\\end{{verbatim}}", True), (f"\\section{{\\textbf{{{w}}}}}", True), (f"\\ref{{{r.choice(_SYLLABLES)}:{k}}}", False), (f"\\cite{{a{k}}}", False), ("\\LaTeX", False),
        ])

    def plain(self) -> tuple[str, bool]:
        r, k = self.r, self.number()
        a, b = r.choice(_SYLLABLES), r.choice(_SYLLABLES)
        return r.choice([
            (f"chiều dài {r.choice('abx')} <= {k} m, rộng {r.choice('ab')} >= {self.number()} m", False), (f"tải < {k} tấn và > {self.number()} tấn", False), (f"{r.choice('xyn')}<{k}", False), (f"Công ty {r.choice('ABR')} & {r.choice('BD')}", False), (f"{r.choice('RA')}&{r.choice('DB')}", False), (f"{a} & {b}", False),
            (f"nhà #{k}", False), (f"số #{k} ngõ", False), (f"ghi chú [{r.randint(1, 30)}] ở cuối bảng", False), (f"[{a} {b}]", False), (f"Ký hiệu {{{r.choice('ABC')}{r.randint(1, 9)}}} chỉ làn", False), (f"chi ${k} và {self.number()} đồng", False), (f"${k} đến ${self.number()} mỗi xe", False), (f"giá ${k}", False),
            (f"C:\\{a}_{b}\\{b}_{r.randint(1, 9)} đã", False), (f"D:\\{r.choice(['data', 'temp', 'begin', 'text'])}\\{r.choice(['new', 'item', 'section'])}", False), (f"mã TL_{k}_{r.randint(1, 9)} còn", False), (f"tep_{k}.pdf", False), (f"là {k} * 3 = {self.number()}", False), (f"{k}*{self.number()}", False), (f"sai số ~{k}%", False),
            (f"- {self.sentence()}", True), (f"{r.randint(1, 20)}. {self.sentence()}", True), (f"{r.choice('abcdđ')}) {self.sentence()}", True), (f"{a} | {b}", False), (f"{a}/{b}", False), (f"'{a} {b}'", False), (f"a = {k}", False), (f"(*) {a}", False), (f"{a}*", False), (f"{a} -- {b}", False), (f"A|B", False), (f"/var/{a}/x_{k}", False), (f"x_{r.randint(1, 9)}", False), (f"#{a}", False),
        ])

    def prose(self) -> tuple[str, list[tuple[int, int, int]]]:
        """A text and its labelled spans."""
        out, spans, at = [], [], 0

        def put(s: str) -> None:
            nonlocal at
            out.append(s)
            at += len(s)

        makers = ((self.html, HTML), (self.markdown, MARKDOWN), (self.wiki, WIKI), (self.latex, LATEX), (self.plain, NONE))
        for _ in range(self.r.randint(2, 7)):
            if self.r.random() < 0.55:
                put(self.sentence() + self.r.choice([" ", " ", "\n", "\n\n"]))
                continue
            make, label = self.r.choice(makers)
            s, own_line = make()
            if own_line and at and not out[-1].endswith("\n"):
                put("\n")
            elif not own_line and at and not out[-1].endswith((" ", "\n")):
                put(" ")
            if label != NONE:
                spans.append((at, at + len(s), label))
            put(s)
            put("\n" if own_line else self.r.choice([" ", " ", ".", "\n", ". " + self.sentence() + " "]))
        return "".join(out), spans

    def page(self) -> tuple[str, list[tuple[int, int]]]:
        """A page and the spans of its furniture."""
        r, out, furniture, at = self.r, [], [], 0

        def put(s: str, drop: bool = False) -> None:
            nonlocal at
            if drop:
                furniture.append((at, at + len(s)))
            out.append(s)
            at += len(s)

        put("<!DOCTYPE html>\n<html>")
        put(f"<head><title>{self.words(4, 9)}</title><style>.a{{color:#333}}</style><script>if (p < 3) {{ q(); }}</script></head>", True)
        put("<body>")
        links = "".join(f"<a href='/{r.choice(_SYLLABLES)}'>{self.words(1, 3)}</a>" for _ in range(r.randint(1, 5)))
        items = f"<ul>{''.join(f'<li>{x}</li>' for x in links.split('</a>')[:1] * 2)}</ul>"
        if r.random() < 0.9:
            put(r.choice([f"<nav>{links}</nav>", f"<header><h1>{self.words(2, 4)}</h1>{links}</header>", f'<div class="menu">{links}</div>', f'<div id="breadcrumb">{links}</div>', f'<nav class="nav">{items}</nav>', f'<div class="banner"><button>{self.words(1, 2)}</button></div>']), True)
        box = r.choice(['<div class="fulltext">', '<div id="toanvancontent">', '<div class="x content">', "<article>", "<main>", ""])
        put(box)
        for _ in range(r.randint(2, 7)):
            w = " ".join(self.sentence() for _ in range(r.randint(1, 3)))
            put(r.choice([f"<p>{w}</p>\n", f'<p style="text-indent:{r.randint(1, 40)}px"><span>{w}</span></p>\n', f"<h{r.randint(1, 6)}>{self.words(2, 6)}</h5>\n", f"<div><b>{self.words(2, 8)}</div>\n", f"<ol><li>{w}<ul><li>{self.words()}</li></ul></li></ol>", f"<table border=1><tr><td>{self.words(1, 3)}</td><td>{self.number()}</td></tr></table>", f"<p align=justify>{w}\n", f"<pre><code>{self.words()}</code></pre>", f'<p>{w} <a href="/x">{self.words(1, 3)}</a>.</p>']))
        if r.random() < 0.4:
            put(r.choice(["<script>var a = 1;</script>", f"<noscript>{self.words()}</noscript>", f"<aside>{links}</aside>", f"<iframe src='/x'></iframe>", f"<button>{self.words(1, 2)}</button>", f'<div class="share">{links}</div>']), True)
        if box and r.random() < 0.9:
            put("</div>" if box.startswith("<div") else box.replace("<", "</"))
        if r.random() < 0.9:
            put(r.choice([f"<footer>{self.words(2, 6)} {self.number()}</footer>", f'<div class="footer">{self.words(2, 6)}</div>', f"<footer>{links}</footer>", f'<div id="copyright">{self.words(2, 5)}</div>']), True)
        if r.random() < 0.8:
            put("</body></html>")
        return "".join(out), furniture


def prose(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    m = _Maker(seed)
    return [m.prose() for _ in range(n)]


def pages(n: int, seed: int) -> list[tuple[str, list[tuple[int, int]]]]:
    m = _Maker(seed)
    return [m.page() for _ in range(n)]
