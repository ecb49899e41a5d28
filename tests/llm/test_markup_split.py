"""Markup kinds and clean text; content-defined pieces."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexforge.llm import chunking, dom, markup, samples, splitting


def kinds(text):
    return {samples.KINDS[k] for _, ks, _ in markup.classify([text], markup.models(), False) for k in ks} - {"none"}


@pytest.mark.parametrize("text, want", [
    ("<p>a</p>", {"html"}), ("a &nbsp; b", {"html"}), ("x <!-- y --> z", {"html"}), ("&lt;p&gt;a&lt;/p&gt;", {"html"}), ("km<sup>2</sup>", {"html"}), ("<div><b>Điều 3", {"html"}),
    ("## Điều 5\nx", {"markdown"}), ("một **hai ba** bốn", {"markdown"}), ("__Mức thu từ__ 5", {"markdown"}), ("xem [đến](https://a.example/1) 5", {"markdown"}), ("![sơ đồ](hinh_1.png)", {"markdown"}), ("```json\nma: 1\n```", {"markdown"}), ("a\n\n---\n\nb", {"markdown"}), ("| a | b |\n|---|:---:|\n| c | 1 |", {"markdown"}), ("~~cũ~~ mới", {"markdown"}), ("`a)` x", {"markdown"}),
    ("== Phạm vi ==\nx", {"wiki"}), ("'''Mức thu''' từ", {"wiki"}), ("ở [[Điều 5|đây]] và", {"wiki"}), ("x {{ghi chú|số=1}}", {"wiki"}), ('{| class="bang"\n|-\n| A || 1\n|}', {"wiki"}),
    ("tốc $v \\le 5$ km", {"latex"}), ("\\[ S = \\frac{v^2}{2} \\]", {"latex"}), ("\\textbf{Mức} thu", {"latex"}), ("x\\footnote{y}", {"latex"}), ("\\begin{itemize}\n\\item a\n\\end{itemize}", {"latex"}),
    ("1. Một\n2. Hai\na) b\nđ) c", set()), ("- một\n- hai", set()), ("a <= 12 m, b >= 3 m", set()), ("< 9 tấn và > 9,9 tấn", set()), ("nhà #74 ngõ 3", set()), ("R&D và A & B", set()), ("chi $5 và 7 đồng", set()), ("C:\\ho_so\\nam_2020 đã", set()), ("mã TL_8_9", set()), ("90 * 3 = 270", set()), ("ghi chú [9] cuối", set()), ("Ký hiệu {A9}", set()), ("sai ~9%", set()), ("", set()), (None, set()),
    ("a\r\n== Phạm vi ==\r\n| a | b |\r\n|---|---|\r\n| c | d |\r\n", {"wiki", "markdown"}), ("a\r---\rb", {"markdown"}),
    ("<script>var p = $('#n').val(); **x** == y == </script>", {"html"}), ("<b>a</b> và **b** và [[c]] và $x_1$", {"html", "markdown", "wiki", "latex"}),
])
def test_kinds(text, want):
    assert kinds(text) == want


def test_held_out_accuracy():
    x, y = markup._labelled_prose(300, 987)
    assert (markup.models()[0].scores(x).argmax(axis=1) == y).mean() >= 0.99
    px, py = markup._labelled_pages(40, 986)
    assert (markup.models()[1].scores(px).argmax(axis=1) == py).mean() >= 0.99


def test_decoding_has_no_contradictions():
    import numpy as np

    r = np.random.default_rng(2)
    for _ in range(200):
        n = int(r.integers(1, 9))
        parent = [-1] + [int(r.integers(-1, i)) for i in range(1, n)]
        score = r.normal(size=(n, 3))
        got = markup.decode(parent, score, 0)
        best = None
        for code in range(3**n):
            lab = [code // 3**i % 3 for i in range(n)]
            if any(p >= 0 and lab[p] == 0 and lab[i] != 0 for i, p in enumerate(parent)):
                continue
            s = sum(score[i, k] for i, k in enumerate(lab))
            best = s if best is None else max(best, s)
        assert all(not (p >= 0 and got[p] == 0 and got[i] != 0) for i, p in enumerate(parent))
        assert abs(sum(score[i, k] for i, k in enumerate(got)) - best) < 1e-9


@pytest.mark.parametrize("text, want", [
    ("<nav><a href='/'>Trang chủ</a></nav><h2>Chương I</h2><p>a &amp; b</p><footer>Cổng 8</footer>", "## Chương I\n\na & b"),
    ("<table><tr><td>B</td><td>48</td></tr></table>", "B | 48"), ("<pre><code>x = 1</code></pre>", "```\nx = 1\n```"), ("m<sup>2</sup>", "m^2"), ("&lt;p&gt;a&lt;/p&gt;", "a"),
    ("một **hai** [ba](u) ~~bốn~~", "một hai ba bốn"), ("| a | b |\n|---|---|\n| c | 1 |", "a | b\n\nc | 1"), ("```json\nma: 1\n```", "```json\nma: 1\n```"),
    ("== Phạm vi ==\n'''Mức''' ở [[Điều 5|đây]]{{ghi chú}}", "## Phạm vi\nMức ở đây".replace("## Phạm", "## Phạm")), ("\\section{Điều 9}\n\\textbf{x} $v^2$", "## Điều 9\nx $v^2$"), ("\\begin{itemize}\n\\item xe tải\n\\end{itemize}", "-  xe tải"),
    ("a <= 12 và C:\\x_y", "a <= 12 và C:\\x_y"),
])
def test_clean(text, want):
    got = markup._clean_all([text], markup.models())[0]
    assert " ".join(got.split()) == " ".join(want.split())


def test_tables(spark):
    rows = [("t", "1", "<b>x</b>", 1), ("t", "1", "<b>x</b>", 1), ("t", "2", None, 1), ("t", "3", "", 1), ("t", None, "<b>", 1), ("t", "4", "plain", 1), ("t", "5", "<p>" + "chữ " * 50_000 + "</p>", 1)]
    df = spark.createDataFrame(rows, "source_table string, record_key string, text string, markup int")
    assert {(r.record_key, r.markup) for r in markup.found_kinds(df).collect()} == {("1", "html"), ("5", "html")}
    got = [(r.record_key, r.clean_text) for r in markup.clean_texts(df).collect()]
    assert len(got) == 7 and dict(got)["1"] == "x" and dict(got)["2"] is None and dict(got)["4"] == "plain"
    assert markup.found_kinds(df.limit(0)).count() == 0
    assert not list(dom.parse("").kind)


words = st.lists(st.sampled_from(["xe", "tải\n", "dừng. ", "\n1. một ", "Điều 5", " ", "aaaaaaaaaaaaaaaaaaaaaaaaa", "é", "\r\n", "-"]), max_size=120).map("".join)


@settings(max_examples=150, deadline=None)
@given(words, st.integers(30, 120), st.integers(0, 20))
def test_pieces_cover_the_text(text, limit, overlap):
    got = chunking.pieces(text, limit, overlap)
    assert "".join(text[c:e] for _, c, e, _ in got) == text
    for k, (s, c, e, p) in enumerate(got):
        assert p == text[s:e] and len(p) <= limit and 0 <= c - s <= overlap
        assert k == 0 or c == got[k - 1][2]
    assert len(got) == 1 or len(text) > limit


def test_cuts_prefer_boundaries_and_edits_stay_local():
    text = "\n".join(f"{i}. Câu số {i} nói về một điều khác hẳn với câu trước đó." for i in range(200))
    got = chunking.pieces(text, 1500, 150)
    assert all(text[e - 1] == "\n" for _, _, e, _ in got[:-1])
    edited = text[:1200] + "chèn thêm mấy chữ " + text[1200:]
    a, b = ({p for *_, p in chunking.pieces(t, 1500, 150)} for t in (text, edited))
    assert len(a - b) <= 3


def test_oversized_items(spark):
    rows = [("1", ("d", {"Điều": "x " * 200, "Chương": "y"}), "z" * 1501), ("2", ("d", None), "z" * 1500), ("3", None, None), ("4", ("d", {"Mục": None}), ""), ("1", ("d", {"Điều": "x " * 200, "Chương": "y"}), "z" * 1501)]
    df = spark.createDataFrame(rows, "chunk_id string, metadata struct<doc_id: string, hierarchy: map<string, string>>, original_text string")
    got = splitting.split_items(splitting.oversized_items(df)).distinct().collect()
    assert {(r.id, r.item) for r in got} == {("1", "original_text"), ("1", "Điều")}
    assert all(len(r.piece) <= r.limit_chars for r in got)


def cleaned(text):
    return markup._clean_all([text], markup.models())[0]


def test_clean_keeps_formulas():
    got = cleaned("Công thức sau.\n\\begin{equation} v = \\frac{a^2}{2 b} + \\alpha \\end{equation}\nHết đoạn này.")
    assert "v = \\frac{a^2}{2 b} + \\alpha" in got and "equation" not in got and got.startswith("Công thức") and got.endswith("Hết đoạn này.")
    assert "x &= 1 \\\\" in cleaned("Cho hệ:\n\\begin{align*}\nx &= 1 \\\\\ny &= 2\n\\end{align*}\n")
    got = cleaned("<p>Diện tích <math><mi>S</mi><mo>=</mo><mfrac><mrow><mi>a</mi><mo>+</mo><mi>b</mi></mrow><mn>2</mn></mfrac><msup><mi>h</mi><mn>2</mn></msup></math> là</p>")
    assert got == "Diện tích $S = \\frac{a + b}{2} h^2$ là"
    assert cleaned("Tốc độ $v = \\frac{s}{t}$ là") == "Tốc độ $v = \\frac{s}{t}$ là"


def test_clean_keeps_code():
    assert cleaned("<p>Thẻ <code>&lt;b&gt;x&lt;/b&gt;</code> in đậm và &lt;i&gt;nghiêng&lt;/i&gt;</p>") == "Thẻ <b>x</b> in đậm và nghiêng"
    got = cleaned("Mẫu:\n\\begin{verbatim}\n\\section{A} **x** &lt;b&gt;\n\\end{verbatim}\nsau đó &lt;p&gt;hết&lt;/p&gt;")
    assert "```\n\\section{A} **x** &lt;b&gt;\n```" in got and "<p>" not in got and got.endswith("hết")
    assert "```\nif (a < b) {\n    c();\n}\n```" in cleaned("<div><pre><code>if (a &lt; b) {\n    c();\n}</code></pre></div>")
    assert "\ue000" in cleaned("ký tự \ue0007\ue001 có sẵn <b>đậm</b>")


def test_clean_keeps_structure():
    assert cleaned("* xe tải\n* xe khách\n\n**Lưu ý:** đi chậm").startswith("- xe tải\n- xe khách")
    assert cleaned("> **Trích** lời nói\n> tiếp theo") == "Trích lời nói\ntiếp theo"
    assert cleaned("\\section{\\textbf{Quy định}}\nNội dung ở đây.") == "## Quy định\nNội dung ở đây."
    assert cleaned("Chương một\n=====\n\nNội dung **đậm** ở đây.").startswith("# Chương một\n")
    assert cleaned("<ol><li>một</li><li>hai<ul><li>con</li></ul></li><li>ba</li></ol>") == "1. một\n2. hai\n\n- con\n\n3. ba"
    assert "dài 5 km" in cleaned("Đoạn '''dài''' {{convert|5|km}} [[đường|qua]] cầu").replace("  ", " ")
