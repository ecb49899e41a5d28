"""Column functions on hand-written rows."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexforge.functions import headings as H
from lexforge.functions import text as X
from lexforge.operators import html
from lexforge.operators.splitting import SIZE, split_text
from pyspark.sql import functions as F


def apply(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_prettify_date(spark):
    given_ = ["2025-01-01T00:00:00", "2025-1-1", "2025-01", None, "", "N/A", "None", "2025-01-01 00:00:00"]
    none = "Chưa xác định"
    assert apply(spark, X.prettify_date, given_) == ["01/01/2025", "1/1/2025", "2025-01", none, none, none, none, "01 00:00:00/01/2025"]


def test_clean_id(spark):
    assert apply(spark, X.clean_id, [None, "", " 173920 ", "\u00a05\u3000"]) == ["Unknown_ID", "Unknown_ID", "173920", "5"]


@pytest.mark.parametrize("text, want", [
    ("**Điều 5. Phạm vi**", "##### Điều 5\nPhạm vi**"),
    ("Chương I\n\nQUY ĐỊNH CHUNG", "## Chương I\nQUY ĐỊNH CHUNG"),
    ("Mục 1\nMục 2", "### Mục 1\nMục 2"),
    ("Tiểu mục 3: abc", "#### Tiểu mục 3\nabc"),
    ("Phần mềm", "# Phần m\nềm"),
    ("IV. Tổ chức", "## IV. Tổ chức"),
    ("iv. Tổ chức", "iv. Tổ chức"),
    ("\u00a0ĐIỀU 7. X", "##### ĐIỀU 7\nX"),
    ("a\n\n\n\nb", "a\n\nb"),
])
def test_headings(spark, text, want):
    assert apply(spark, H.normalize_headings, [text]) == [want]


def test_contextual_text(spark):
    f = lambda c: X.contextual_text(F.get(F.split(c, "/"), 0), F.get(F.split(c, "/"), 1))
    assert apply(spark, f, ["/t", "c/t"]) == ["t", "c\n\nNội dung chi tiết:\nt"]


def test_page_count(spark):
    df = spark.createDataFrame([(41,)], "n int")
    assert [df.select(X.page_count(F.col("n"), s)).first()[0] for s in (20, 0, 41)] == [3, 1, 1]


@pytest.mark.parametrize("page, want", [
    ('<div id="toanvancontent">A</div><div class="content">B</div>', "A"),
    ('<div class="content">B</div><div class="x fulltext">C</div>', "C"),
    ("<p>no container</p>", ""),
    ("<body><nav>x</nav><p>hi <a href=u>link</a><img src=i></p><script>'</p>'</script>", "hi link"),
    ("<body><div class='fulltext'><div>in</div> tail</div>out", "in\n\ntail"),
    ("<body><ol><li>a<ul><li>b</li></ul></li><li>c</li></ol>", "1. a\n    * b\n  2. c"),
    ("", ""),
])
def test_main_container(page, want):
    assert html.page_to_markdown(page).strip() == want
    assert html.page_to_markdown(None) is None


texts = st.text(alphabet="ab .\nđ", min_size=0, max_size=400)


@settings(max_examples=150, deadline=None)
@given(texts, st.integers(5, 60))
def test_size_split_properties(text, size):
    overlap = size // 4
    text = "".join(chr(0x4E00 + i) if c in "abđ" else c for i, c in enumerate(text))  # letters tell places apart
    got = split_text(text, size, overlap)
    assert all(0 < len(p) <= size and p in text for p in got)
    letters = lambda t: [c for c in t if c >= "\u4e00"]
    seen = []
    for p in got:  # in order, nothing left out, no more than the overlap twice
        own = letters(p)
        again = sum(c in seen for c in own)
        assert own[:again] == (seen[-again:] if again else []) and again <= overlap
        seen += own[again:]
    assert seen == letters(text)


def test_size_split_short_texts_pass():
    assert split_text("x" * (SIZE - 1)) == ["x" * (SIZE - 1)]
    assert split_text(None) == [] and split_text("") == []
    assert all(len(p) <= SIZE for p in split_text("x" * 5000))
