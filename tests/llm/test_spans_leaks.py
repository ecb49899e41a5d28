"""Shared spans and leaked items against brute force."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexforge.llm import leakage, spans


def common(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                new[j + 1] = row[j] + 1
                best = max(best, new[j + 1])
        row = new
    return best


def texts(seed=4):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("abcdeđ ") for _ in range(n))
    shared = [word(n) for n in (38, 40, 41, 60, 90)]
    out = []
    for i in range(40):
        t = word(r.randint(0, 120))
        for s in r.sample(shared, r.randint(0, 2)):
            k = r.randint(0, len(t))
            t = t[:k] + s + t[k:]
        out.append((i, t))
    return out + [(100, out[3][1]), (101, out[3][1]), (102, None), (103, ""), (104, "x" * 39), (105, "y" * 200), (106, "y" * 120)]


def test_sharing_pairs_against_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows] + [(0, rows[0][1], 1)], "doc_id long, text string, sid int")
    got = {(r.id_a, r.id_b) for r in spans.sharing_pairs(df, "doc_id", "text", 40).collect()}
    live = [(i, t) for i, t in rows if t]
    want = {(a, b) for k, (a, x) in enumerate(live) for b, y in live[k + 1 :] if common(x, y) >= 40}
    assert got == want
    assert spans.sharing_pairs(df.limit(0), "doc_id", "text", 40).count() == 0


@pytest.mark.parametrize("hot", [2, 10_000])
def test_hot_blocks_lose_nothing(spark, monkeypatch, hot):
    monkeypatch.setattr(spans, "HOT_BLOCK", hot)
    r = random.Random(9)
    noise = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    foot, full = noise(35), noise(45)
    rows = [(i, noise(60) + foot + noise(10)) for i in range(8)] + [(20 + i, noise(50) + full + noise(30)) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x.id_a, x.id_b) for x in spans.sharing_pairs(df, "doc_id", "text", 40).collect()}
    assert got == {(a, b) for a in range(20, 25) for b in range(20, 25) if a < b}


def test_shared_parts(spark):
    a, b, c = "a" * 3 + "0123456789" * 5, "0123456789" * 5 + "zz", "q" * 30
    df = spark.createDataFrame([(1, a), (2, b), (3, c), (4, c), (5, None), (6, "tiny")], "doc_id long, text string")
    got = {r.doc_id: (r.n_chars, r.shared_chars, r.n_stretches) for r in spans.shared_parts(df, "doc_id", "text", 20).collect()}
    assert got == {1: (53, 50, 1), 2: (52, 50, 1), 3: (30, 30, 1), 4: (30, 30, 1), 6: (4, 0, 0)}


def covered(rows, least):
    """Characters of each text that lie in windows of ``least`` that another text has."""
    out = {}
    for i, t in rows:
        hit = [False] * len(t)
        for s in range(len(t) - least + 1):
            if any(t[s : s + least] in u for j, u in rows if j != i):
                hit[s : s + least] = [True] * least
        out[i] = sum(hit)
    return out


def test_shared_parts_against_brute_force(spark):
    rows = [(i, t) for i, t in texts(8) if t]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.shared_chars for r in spans.shared_parts(df, "doc_id", "text", 40).collect()}
    assert got == covered(rows, 40) and any(got.values())


def test_ruled_lines_and_periods(spark, monkeypatch):
    monkeypatch.setattr(spans, "HOT_BLOCK", 5)
    rows = [(1, "a" * 10 + "-" * 90), (2, "b" * 7 + "-" * 45 + "c"), (3, "d-" * 30), (4, "x" + "d-" * 25 + "y"), (5, "-" * 39 + "|"), (6, "e" * 39), (7, "| --- | --- " * 9), (8, "z" + "| --- | --- " * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.id_a, r.id_b) for r in spans.sharing_pairs(df, "doc_id", "text", 40).collect()}
    assert got == {(a, b) for k, (a, x) in enumerate(rows) for b, y in rows[k + 1 :] if common(x, y) >= 40} == {(1, 2), (3, 4), (7, 8)}
    assert {r.doc_id: r.shared_chars for r in spans.shared_parts(df, "doc_id", "text", 40).collect()} == covered(rows, 40)


def test_a_footer_in_many_texts_makes_no_pairs_in_shared_parts(spark):
    r = random.Random(5)
    noise = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    foot = noise(50)
    df = spark.createDataFrame([(i, noise(60) + foot) for i in range(10_000)], "doc_id long, text string")
    found = spans._shared_windows(spans._long_texts(spans.keyed(df, "doc_id", "text"), 40), 40).groupBy("sid").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("n")).collect()
    assert len(found) == 10_000 and all(r.e == 110 and 48 <= r.s <= 60 and r.n < 60 for r in found)  # a few characters before the footer may be equal too


def test_probes_are_a_fixed_part_of_the_windows_at_any_size():
    r = random.Random(6)
    for n in (20_000, 400_000):
        t = "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
        rows = sum(len(x[0]) for x in spans.landmark_runs([t], 200, 24))
        assert n / 100 < rows < n / 75  # 2 of 178


def test_long_texts_in_parts(monkeypatch):
    r = random.Random(7)
    t = ["".join(r.choice("ab ") for _ in range(n)) for n in (5_000, 0, 30, 1_001)]
    whole = {x for g in spans.landmark_runs(t, 40, 12) for x in zip(*map(list, g))}
    monkeypatch.setattr(spans, "PART_CHARS", 100)
    parts = [x for g in spans.landmark_runs(t, 40, 12) for x in zip(*map(list, g))]
    at = lambda rows: {(i, s): (h, p) for i, h, p, a, b in rows for s in range(a, b + 1)}
    assert at(parts) == at(whole) and len(at(whole)) == 5_000 - 39 + 1_001 - 39


W = re.compile(r"[^\W_]+")


def fold(t):
    t = "".join(c for c in unicodedata.normalize("NFKD", t or "").lower().replace("đ", "d") if unicodedata.category(c) not in ("Mn", "Mc", "Me"))
    return W.findall(t)


def test_leaks_against_brute_force(spark):
    r = random.Random(2)
    vocab = "Xe tải, đường bộ; người lái phải dừng trước vạch khi đèn đỏ bật sáng ở ngã tư số 7 – và chờ!".split()
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(5, 30)))) for i in range(30)] + [(90, None), (91, ""), (0, "dup dup")]
    docs = []
    for i in range(60):
        t = " ".join(r.choice(vocab) for _ in range(r.randint(0, 40)))
        if r.random() < 0.6:
            w = items[r.randrange(30)][1].split()
            k = r.randint(0, len(w))
            part = " ".join(w[k : k + r.randint(3, 20)])
            part = r.choice([part, part.upper(), unicodedata.normalize("NFD", part), part.replace(" ", "\r\n-"), "".join(c for c in unicodedata.normalize("NFD", part) if not unicodedata.combining(c))])
            t += " " + part + " " + r.choice(vocab)
        docs.append((i, t))
    docs += [(70, None), (71, ""), (5, docs[5][1])]
    d, e = spark.createDataFrame([(*x, "k") for x in docs], "doc_id long, text string, eval_id string"), spark.createDataFrame(items, "eval_id long, text string")
    n = 6
    want = set()
    for i, t in docs:
        w = fold(t)
        runs = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        want |= {(i, j) for j, q in items if any(tuple(fold(q)[k : k + n]) in runs for k in range(len(fold(q)) - n + 1))}
    got = leakage.find_leaks(d, e, "doc_id", "text", "eval_id", "text", n).collect()
    assert {(x.doc_id, x.eval_id) for x in got} == want and want
    by = dict(docs)
    for x in got:  # the stretch of the original holds the runs
        q = fold(dict(items)[x.eval_id]) if x.eval_id else None
        part = fold(by[x.doc_id][x.char_start : x.char_end])
        if q:
            assert any(part[k : k + n] == q[m : m + n] for k in range(len(part)) for m in range(len(q) - n + 1))
    assert leakage.find_leaks(d, e.limit(0), "doc_id", "text", "eval_id", "text", n).count() == 0
    assert leakage.find_leaks(d.limit(0), e, "doc_id", "text", "eval_id", "text", n).count() == 0


def test_leaks_in_several_blocks(spark, monkeypatch):
    items = [(i, " ".join(f"w{i}x{k}" for k in range(15))) for i in range(12)]
    docs = spark.createDataFrame([(i, t + " tail") for i, t in items], "doc_id long, text string")
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 40)
    got = leakage.find_leaks(docs, spark.createDataFrame(items, "eval_id long, text string"), "doc_id", "text", "eval_id", "text")
    assert {(r.doc_id, r.eval_id) for r in got.collect()} == {(i, i) for i in range(12)}


def test_places_of_capital_greek_and_of_marks(spark):
    words = "ΟΔΟΣ ΝΟΜΟΣ Đường bộ một hai ba".split()
    text = "mở đầu: " + unicodedata.normalize("NFD", " - ".join(words)) + "... hết"
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    e = spark.createDataFrame([(5, "οδος νομος duong bo mot hai BA")], "eval_id long, text string")
    (r,) = leakage.find_leaks(d, e, "doc_id", "text", "eval_id", "text", 7).collect()
    assert text[r.char_start : r.char_end] == unicodedata.normalize("NFD", " - ".join(words)) and r.n_runs == 1


def test_many_items_take_one_scan(spark):
    r = random.Random(3)
    items = spark.createDataFrame([(i, " ".join(f"w{r.randrange(5000)}" for _ in range(40))) for i in range(20_000)], "eval_id long, text string")  # 5 MB
    docs = spark.createDataFrame([(1, items.first().text)], "doc_id long, text string")
    got = leakage.find_leaks(docs, items, "doc_id", "text", "eval_id", "text")
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert [(x.doc_id, x.n_runs) for x in got.collect()] == [(1, 28)]
