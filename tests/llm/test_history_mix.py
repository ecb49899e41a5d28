"""Batches against history; mixtures."""

import pytest
from pyspark.sql import functions as F

from lexforge.llm import history as H
from lexforge.llm import mixing as M


@pytest.mark.parametrize("a, b", [
    ("7/2024/LT-HĐGX", "số 007/2O24/lt–hdgx."), ("1043/2024/KH-PCPL", "Số hiệu: 1043 / 2024 / КН-PCPL"), ("549/2004/KH-BQLX", "No. 549/2\u200b004/KH\u2010BQLX\n"), ("1251/2019/TT-UBĐP", "1251/20l9/TT-UBĐP"), ("1492/2006/NĐ-SQLT", "So hieu: 1492/2006/ND-SQLT"),
])
def test_same_numbers(a, b):
    assert H.number_key(a) == H.number_key(b) is not None


@pytest.mark.parametrize("a, b", [("7/2024/LT-HĐGX", "7/2024/LT-HĐGX2"), ("17/2024/LT", "7/2024/LT"), ("7/2024/ĐC-LT", "7/2024/LT")])
def test_other_numbers(a, b):
    assert H.number_key(a) != H.number_key(b)


def test_placeholders_and_items():
    assert all(H.number_key(x) is None for x in (None, "", " ", "Unknown", "N/A", "unknown_id"))
    assert all(H.item_key(x) is None for x in (None, "", "Unknown_ID", "N/A"))
    assert {H.item_key(x) for x in ("1000731", "01000731", "1000731.html", "1000731.0", "１０００７３１", " 1000731\n")} == {"1000731"}


META = "row_id long, batch_no int, item_id string, doc_number string, h string"


def test_batches_are_checked_in_order(spark):
    rows = [
        (1, 1, "10", "1/2020/A", "x"), (2, 1, "11", None, None), (3, 1, "010", "9/2020/B", None), (4, 1, "77", "9/2020/B", None), (5, 2, "12", "1/2020/a.", None), (6, 2, "Unknown", "Unknown", None), (7, 2, "Unknown", "", None),
        (8, 3, "11.html", None, None), (9, 3, "99", "5/2021/C", None), (9, 3, "99", "5/2021/C", None), (10, None, "99.0", None, None), (None, 3, "10", None, None),
    ]
    df = spark.createDataFrame(rows, META)
    got = {(r.first_row_id, r.row_id) for r in H.repeated_documents(df).collect()}
    assert got == {(1, 3), (1, 4), (1, 5), (2, 8), (9, 10)}
    assert H.repeated_documents(df.limit(0)).count() == 0


def test_history_is_bucketed_and_not_shuffled(spark):
    seen = H.SeenHashes(spark, "t", 4)
    seen.append(spark.range(1000).select(F.xxhash64("id").alias("h"), F.col("id").alias("first")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        j = spark.range(10).select(F.xxhash64("id").alias("h")).repartition(seen.buckets, "h").join(seen.known(), "h")
        assert j.count() == 10
        plan = j._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1


def test_a_standing_history_is_opened_again(spark, tmp_path):
    day = lambda rows: spark.createDataFrame(rows, "row_id long, batch_no int, item_id string, doc_number string")
    path = f"file://{tmp_path}/seen"
    assert H.repeated_documents(day([(1, 1, "10", "1/2020/A"), (2, 1, "11", None)]), seen=H.SeenHashes(spark, path=path)).count() == 0
    other = spark.newSession()  # a catalog that doesn't know the table
    second = day([(3, 2, "0010.html", None), (4, 2, "12", None), (5, 2, "12", "1/2020/a.")])
    again = H.repeated_documents(other.createDataFrame(second.toPandas(), second.schema), seen=H.SeenHashes(other, path=path))
    assert {tuple(r) for r in again.collect()} == {(1, 3), (1, 5)}
    third = day([(6, 3, "12", None), (7, 3, "99", None)])
    assert {tuple(r) for r in H.repeated_documents(third, seen=H.SeenHashes(spark, path=path)).collect()} == {(4, 6)}
    # checked once more, as after a crash: the same rows
    assert {tuple(r) for r in H.repeated_documents(third, seen=H.SeenHashes(spark, path=path)).collect()} == {(4, 6)}


def test_a_small_batch_reads_few_rows_of_a_long_history(spark):
    read = {}
    for size in (200_000, 1_600_000):
        seen = H.SeenHashes(spark, "long", 4)
        seen.append(spark.range(size).select(F.xxhash64("id").alias("h"), F.col("id").alias("first")))
        seen.merge(size)
        keys = spark.range(3).select((F.col("id") + 10_000_000).alias("row_id"), F.xxhash64(F.col("id") * 7).alias("h"))
        assert {(r.first_row_id, r.row_id) for r in H.check_batch(seen, keys).collect()} == {(7 * i, 10_000_000 + i) for i in range(3)}
        spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", "5000")
        df = seen.known().where(F.col("h").isin([r.h for r in keys.collect()]))
        df.collect()
        read[size] = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()
        spark.conf.unset("spark.sql.parquet.pushdown.inFilterThreshold")
        seen.release()
    assert max(read.values()) <= 3 * 2 * H.PAGE_ROWS


def test_files_are_merged_and_buckets_doubled(spark, monkeypatch):
    monkeypatch.setattr(H, "MERGE_AFTER", 3)
    monkeypatch.setattr(H, "BUCKET_ROWS", 20)
    seen = H.SeenHashes(spark, "merge", 2)
    for k in range(7):
        seen.append(spark.range(10 * k, 10 * k + 10).select(F.xxhash64("id").alias("h"), F.col("id").alias("first")))
    assert seen.buckets == 4 and seen.state["base"] == 60 and seen.state["appends"] == 1
    assert sorted(r.first for r in H.SeenHashes(spark, path=seen.path).known().collect()) == list(range(70))


def test_paragraph_coverage(spark):
    p = ["một hai ba bốn năm", "sáu bảy tám chín mười", "xe tải dừng trước vạch", "ngắn"]
    rows = [(1, 1, "\n".join(p[:2])), (2, 1, p[2]), (3, 2, "\n".join([p[0].upper(), p[2]])), (4, 2, "\n".join([p[1], "hoàn toàn mới ở đây"])), (5, 2, "\n".join(p[:2]) + "."), (6, 2, None), (7, 2, " ")]
    got = {r.row_id: r for r in H.paragraphs_seen(spark.createDataFrame(rows, "row_id long, batch_no int, text string"), "row_id", "batch_no", "text", "\n").collect()}
    assert {k: (r.n_paragraphs, r.n_shared, r.coverage) for k, r in got.items()} == {1: (2, 0, 0.0), 2: (1, 0, 0.0), 3: (2, 2, 1.0), 4: (2, 1, 0.5), 5: (2, 2, 1.0), 6: (0, 0, 0.0), 7: (0, 0, 0.0)}
    assert {k: r.full_copy_of for k, r in got.items() if r.full_copy_of} == {5: 1}


def test_short_paragraphs_count(spark):
    rows = [(1, 1, 'xe tải dừng trước vạch\n"nodeId": 9\n"role": "Phó ban"'), (2, 2, 'xe tải dừng trước vạch\n"nodeId": 10\n"role": "Phó ban"'), (3, 2, '"nodeId": 9\n--\n\n'), (4, 2, "{}")]
    got = {r.row_id: r for r in H.paragraphs_seen(spark.createDataFrame(rows, "row_id long, batch_no int, text string"), "row_id", "batch_no", "text", "\n").collect()}
    assert {k: (r.n_paragraphs, r.n_shared, r.coverage) for k, r in got.items()} == {1: (3, 0, 0.0), 2: (3, 2, 0.666667), 3: (1, 1, 1.0), 4: (0, 0, 0.0)}


def test_fill_redistributes():
    assert M._fill(100, [0.5, 0.5], [10, 1000]) == [10, 90]
    assert M._fill(100, [0.5, 0.3, 0.2], [1000, 0, 1000]) == pytest.approx([71.428571, 0, 28.571429])
    assert sum(M._fill(100, [0.5, 0.5], [10, 20])) == 30
    assert M._fill(10, [0.0, 0.0], [5, 5]) == [0, 0]


DOC = "doc_id long, text string, source string, lang string, n_tokens string"


def mixture(spark):
    docs = [(i, f"tài liệu số {i} " * 20, "Big ", "vi" if i % 3 else "EN-us", "x") for i in range(300)] + [(1000 + i, f"nhỏ {i} " * 20, "sm-all", None, "x") for i in range(20)] + [(2000, None, "big", "vi", "x"), (2001, "  ", "big", "vi", "x"), (2002, "khác " * 50, None, "vi", "x"), (2003, "khác " * 50, "other", "vi", "x")]
    targets = [("big", 0.5, 1), ("SM_ALL", 0.4, 3), ("gone", 0.1, 9), (None, 0.3, 1)]
    return M.Mixture(spark.createDataFrame(docs, DOC), spark.createDataFrame(targets, "source string, target_weight double, max_repeats int"))


def test_mixture(spark):
    m = mixture(spark)
    assert {r.source for r in m.short_sources().collect()} == {"SM_ALL", "gone"}
    d = m.documents().collect()
    assert len({r.doc_id for r in d}) == len(d) and all(r.n_uses <= (1 if r.source == "big" else 3) for r in d)
    assert {r.n_uses for r in d if r.source == "sm_all"} == {3}
    rows = m.shares().collect()
    by = {r.source: r for r in rows if r.level == "target"}
    # every level adds up to the one above
    for level in ("domain", "language", "leaf", "target"):
        assert sum(r.mixture_tokens for r in rows if r.level == level) == next(r.mixture_tokens for r in rows if r.level == "mixture") > 0
    assert by["gone"].mixture_tokens == 0 and by["gone"].short and abs(sum(r.actual_share for r in by.values()) - 1) < 1e-5
    # the prefix ends within one document of the budget
    longest = max(r.n_tokens for r in d)
    assert 0 <= by["big"].budget_tokens - by["big"].mixture_tokens <= 3 * longest
    assert {r.doc_id for r in mixture(spark).documents().collect()} == {r.doc_id for r in d}


def test_mixture_of_nothing(spark):
    docs = spark.createDataFrame([], DOC)
    m = M.Mixture(docs, spark.createDataFrame([("a", 1.0, 2)], "source string, target_weight double, max_repeats int"))
    assert m.documents().count() == 0 and all(r.actual_share == 0 for r in m.shares().collect())


def budgets(tokens, targets, total):
    return {x.path: round(x.budget) for x in M.plan_tree(tokens, targets, total).walk()}


def test_siblings_take_a_shortage_before_uncles():
    tokens = {("law", "vi", "a"): 100, ("law", "vi", "b"): 1000, ("law", "en", "c"): 1000, ("news", "vi", "d"): 1000}
    targets = {"a": (0.4, 1), "b": (0.2, 1), "c": (0.2, 1), "d": (0.2, 1)}
    got = budgets(tokens, targets, 1000)
    assert got[("law", "vi", "a")] == 100 and got[("law", "vi", "b")] == 500  # the language's other source takes it all
    assert got[("law", "en", "c")] == got[("news", "vi", "d")] == 200
    # a language that is full hands on to the domain's other language, not to the other domain
    got = budgets(tokens | {("law", "vi", "b"): 300}, targets, 1000)
    assert (got[("law", "vi")], got[("law", "en", "c")], got[("news",)]) == (400, 400, 200)
    # a domain that is full hands on to the other domain
    got = budgets(tokens | {("law", "vi", "b"): 300, ("law", "en", "c"): 250}, targets, 1000)
    assert (got[("law",)], got[("news", "vi", "d")], got[()]) == (650, 350, 1000)
    rows = {s["source"]: s["short"] for s in M.source_rows(M.plan_tree(tokens, targets, 1000), targets, 1000)}
    assert rows == {"a": True, "b": False, "c": False, "d": False}


def test_tokens_of_pieces_are_those_of_the_text(monkeypatch):
    import random

    r = random.Random(1)
    text = "".join(r.choice(["xe", "Tải ", " ", "\n", "12", ",", "  ", "đường", "'s", " - "]) for _ in range(3000))
    e = M._encoder(M.TOKENIZER)
    monkeypatch.setattr(M, "PIECE", 50)
    parts = list(M.token_pieces(text))
    assert "".join(parts) == text and len(parts) > 50 and [t for p in parts for t in e.encode_ordinary(p)] == e.encode_ordinary(text)
    assert list(M.token_pieces("a" * 500)) == ["a" * 500] and list(M.token_pieces("")) == [""]
