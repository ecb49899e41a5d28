"""Crawl state, graph, retrieval, sources and the chain of stages on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from lexforge.operators import crawlstate as C
from lexforge.operators import enrich, graph, retrieve, vectors
from lexforge.plans import pipeline
from lexforge.sources import files, paged
from lexforge.streaming.ingest import ingest_new_items


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_last_and_first_wins(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (1, "c", 3)], "k int, v string, s int")
    assert rows(C.last_wins(df, "k", "s"), "k", "v") == [(1, "c"), (2, "b")]
    assert rows(C.first_wins(df, "k", "s"), "k", "v") == [(1, "a"), (2, "b")]


def test_failed_set_and_upsert(spark):
    f = spark.createDataFrame([("1", 1), ("2", 1), ("3", 1), ("3", 2), (None, 9), ("", 9)], "id string, n int")
    ok = spark.createDataFrame([("2",)], "id string")
    assert rows(C.failed_set(f, ok, "id", [F.desc("n")]), "id", "n") == [("1", 1), ("3", 2)]
    new = spark.createDataFrame([("1", 7), ("9", 9)], "id string, n int")
    assert rows(C.upsert(f.where("id in ('1', '2')"), new, "id"), "id", "n") == [("1", 7), ("2", 1), ("9", 9)]


def test_positions_are_global(spark):
    df = spark.range(1000).select((F.lit(999) - F.col("id")).alias("k")).repartition(7)
    got = C.number_rows(df, [F.asc("k")]).orderBy("position").collect()
    assert [r.k for r in got] == list(range(1000)) and [r.position for r in got] == list(range(1, 1001))
    assert C.number_rows(df.limit(0), [F.asc("k")]).count() == 0
    pages = C.paginate(df.where("k < 41"), [F.asc("k")], 20).groupBy("page_no").count()
    assert rows(pages, "page_no", "count") == [(1, 20), (2, 20), (3, 1)]


def test_retry_rounds(spark):
    f = spark.createDataFrame([(i,) for i in range(6)], "id int")
    got = rows(C.retry_rounds(f, "id", lambda r: F.col("id") % 4 == r), "id", "resolved_round")
    assert got == [(0, None), (1, 1), (2, 2), (3, 3), (4, None), (5, 1)] or [g[1] for g in got] == [None, 1, 2, 3, None, 1]


def test_rejects_are_single_rows(spark):
    df = spark.createDataFrame([("a" * 300, "x"), ("b", None)], "chunk_id string, doc_id string")
    good, bad = C.split_rejects(df, enrich.length_checks({"chunk_id": 200, "doc_id": 100}))
    assert rows(good, "chunk_id") == [("b",)] and bad.first().reasons == ["chunk_id"]


def test_metadata_lookup(spark):
    m = spark.createDataFrame([("1", "A", '{"effFrom":"2020-01-01"}', 1), ("1", "B", '{"effFrom":"2021-01-01"}', 2), ("2", None, '{"eff', 3)], "item_id string, doc_number string, metadata_api string, row_id long")
    d = spark.createDataFrame([("1",), ("2",), ("9",)], "doc_id string")
    assert rows(enrich.metadata_lookup(d, m), "doc_id", "doc_number", "effective_date") == [("1", "B", "2021-01-01"), ("2", "2", "Chưa xác định"), ("9", "9", "Chưa xác định")]


CHUNK = "chunk_id string, metadata struct<doc_id: string, doc_number: string, effective_date: string, hierarchy: map<string, string>>, original_text string, written_at timestamp"


def test_context_with_and_without_path(spark):
    c = spark.createDataFrame([("7_chunk_1", ("7", "5/2020", "2020-01-02T00:00:00", {"Chương": "I", "Điều": "Điều 3"}), "body", None)], CHUNK)
    v = spark.createDataFrame([("7_chunk_1", [1.0, 0.0], "body"), ("8_chunk_1", [0.0, 1.0], "lone"), ("9", [0.0, 0.0], "zero"), ("10", None, "null"), ("11", [float("nan"), 1.0], "nan")], "chunk_id string, embedding array<float>, original_text string")
    r = retrieve.Retriever(v, graph.graph_rows(c), lambda qs: [[1.0, 0.1] for _ in qs], answer=lambda p: str(len(p)), dim=2)
    got = rows(r.search_context(["?"], 2), "rank", "chunk_id", "doc_info", "effective_date", "article")
    assert got == [(1, "7_chunk_1", "Văn bản chưa xác định (Số hiệu: 5/2020)", "02/01/2020", "Điều 3"), (2, "8_chunk_1", "N/A (Số hiệu: N/A)", "Chưa xác định", "N/A")]
    a = r.ask(["luật gì"], 2).first()
    assert a.prompt.endswith("CÂU HỎI: luật gì") and "TÀI LIỆU 1:\n- Văn bản: " in a.prompt and int(a.answer) == len(a.prompt)


def test_search_ties_and_empty(spark):
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id bigint, vec array<float>")
    c = spark.createDataFrame([(i, [2.0, 0.0]) for i in (5, 3, 4)], "id bigint, vec array<float>")
    assert rows(vectors.search(q, c, 2, 2), "rank", "id") == [(1, 3), (2, 4)]
    assert vectors.search(q.limit(0), c, 2, 2).count() == 0 and vectors.search(q, c.limit(0), 2, 2).count() == 0


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"item_id":"1"}\n\n{"item_id":\n{"item_id":"2"}\n')
    assert rows(files.read_jsonl(spark, str(p), "item_id string"), "item_id") == [("1",), ("2",)]
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(p), "item_id string", strict=True).collect()
    p.write_text('{"other":"1"}\n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(p), "item_id string", strict=True, required="item_id").collect()
    files.append_jsonl(spark.createDataFrame([("Chương",)], "v string"), str(tmp_path / "o"))
    files.append_jsonl(spark.createDataFrame([("x",)], "v string"), str(tmp_path / "o"))
    assert rows(files.read_jsonl(spark, str(tmp_path / "o"), "v string"), "v") == [("Chương",), ("x",)]


def test_whole_files(spark, tmp_path):
    (tmp_path / "5.html").write_text("<body>\nx</body>", encoding="utf-8")
    (tmp_path / "6.md").write_text("# x", encoding="utf-8")
    assert rows(files.read_html_dir(spark, str(tmp_path)), "doc_id", "html") == [("5", "<body>\nx</body>")]
    assert rows(files.read_markdown_dir(spark, str(tmp_path)), "doc_id", "md") == [("6", "# x")]


def test_paged_source_isolates_failures(spark):
    def fetch(page, size, filters):
        if page == 2:
            raise ValueError("page is lost")
        return [json.dumps({"id": (page - 1) * size + i}) for i in range(min(size, 5 - (page - 1) * size))], 5

    spark.dataSource.register(paged.paged_source("listing", fetch))
    got = spark.read.format("listing").option("pageSize", 2).load().collect()
    assert sorted((r.page, r.item) for r in got if r.error is None) == [(1, '{"id": 0}'), (1, '{"id": 1}'), (3, '{"id": 4}')]
    assert [r.page for r in got if r.error] == [2]
    assert list(paged.page_numbers(41, 20)) == [1, 2, 3] and list(paged.page_numbers(41, 0)) == [1]


def test_stream_takes_items_once(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    spark.createDataFrame([("1",), ("2",), ("1",), (None,)], "item_id string").write.parquet(src)
    assert rows(ingest_new_items(spark, src, "item_id string", "item_id", out, state), "item_id") == [("1",), ("2",)]
    spark.createDataFrame([("2",), ("3",)], "item_id string").write.mode("append").parquet(src)
    assert rows(ingest_new_items(spark, src, "item_id string", "item_id", out, state), "item_id") == [("1",), ("2",), ("3",)]


def test_chain_from_page_to_graph(spark):
    body = "x " * 1200
    page = f"<body><p>Chương I</p><p>QUY ĐỊNH</p><p>Điều 1. Phạm vi</p><p>{body}</p><p>Điều 2. Khác</p><p>ngắn</p></body>"
    pages = spark.createDataFrame([("7", page), ("8", ""), ("9", None)], "doc_id string, html string")
    meta = spark.createDataFrame([("7", "5/2020", '{"effFrom":"2020-01-02"}', 1)], "item_id string, doc_number string, metadata_api string, row_id long")
    done = pipeline.run([("md", lambda r: pipeline.markdown_stage(pages)), ("chunks", lambda r: pipeline.chunk_stage(r["md"], meta)), ("graph", lambda r: pipeline.graph_stage(r["chunks"])), ("never", lambda r: 1 / 0)], until="graph")
    got = {r.chunk_id: r for r in done["chunks"].collect()}
    assert all(len(r.original_text) <= 1500 for r in got.values()) and len(got) == 5
    assert got["7_chunk_5"].metadata.hierarchy == {"Chương": "Chương I", "Điều": "Điều 2"}
    assert got["7_chunk_1"].metadata.doc_number == "5/2020"
    assert rows(done["graph"]["articles"], "doc_id", "chapter", "article") == [("7", "Chương I", "Điều 1"), ("7", "Chương I", "Điều 2"), ("7", "Chương I", "Điều N/A")]
    assert graph.broken_keys(done["graph"]["documents"], ["doc_id"]).isEmpty()
    vec, bad = pipeline.vector_stage(done["chunks"], lambda ts: [[float(len(t)), 1.0] for t in ts])
    assert vec.count() == 5 and bad.isEmpty()
    with pytest.raises(ZeroDivisionError):
        pipeline.run([("bad", lambda r: 1 / 0), ("after", lambda r: r)])


def test_sections_with_fences_and_headers(spark):
    from lexforge.operators.splitting import header_sections

    md = {"a": "# A\nt\n## B\nx\n# C\ny", "b": "intro\n##### D\n```\n# no header\n```\nz\n###### six", "c": "# only\n##", "d": "", "e": None, "f": "# A\n\nb​\n c "}
    got = header_sections(spark.createDataFrame(list(md.items()), "k string, md string"), "k", "md").collect()
    out = sorted((r.id, r.first_pos, r.content, *[r[f"level_{i}"] for i in (1, 2, 5)]) for r in got)
    assert out == [
        ("a", 1, "t", "A", None, None), ("a", 3, "x", "A", "B", None), ("a", 5, "y", "C", None, None), ("b", 0, "intro", None, None, None),
        ("b", 2, "```\n# no header\n```\nz\n###### six", None, None, "D"), ("f", 2, "b\nc", "A", None, None),
    ]


def test_stores(spark, tmp_path):
    from lexforge.sources import stores

    items = spark.createDataFrame([("1", "<p>", '{"a":"ế"}'), ("2", "", "{}"), ("3", None, "{cut"), ("4", "x", None)], "item_id string, full_text_html string, diagram_json string")
    assert rows(stores.pages_to_store(items), "item_id", "file_html") == [("1", "1.html"), ("4", "4.html")]
    assert [(r.file_diagram, json.loads(r.diagram_json)) for r in stores.diagrams_to_store(items).collect()] == [("1.json", {"a": "ế"})]
    stores.append_audit(spark.createDataFrame([("q", "a")], "question string, answer string"), str(tmp_path / "log"))
    stores.append_audit(spark.createDataFrame([("r", "b")], "question string, answer string"), str(tmp_path / "log"))
    assert rows(spark.read.parquet(str(tmp_path / "log")), "question") == [("q",), ("r",)]


def test_responses_are_fetched_once(spark, tmp_path):
    from lexforge.sources import stores

    def fetch(url):
        if url == "bad":
            raise ValueError("no such host")
        return (503, "later") if url == "busy" else (200, "body of " + url)

    cache = stores.UpsertTable(spark, str(tmp_path), "url", "url string, status int, body string")
    req = spark.createDataFrame([("a",), ("a",), ("bad",), ("busy",), (None,)], "url string")
    assert rows(stores.fetch_missing(req, cache, fetch), "url", "status") == [("a", 200), ("bad", 0), ("busy", 503)]
    assert rows(cache.read(), "url") == [("a",)]
    again = stores.fetch_missing(req, cache, lambda u: (200, "second"))
    assert rows(again, "url", "body") == [("a", "body of a"), ("bad", "second"), ("busy", "second")]


def test_rescue_stops_when_nothing_is_left(spark):
    from lexforge.sources import stores

    seen = []

    def attempt(open_, r):
        seen.append(r)
        return open_.where(F.col("id") % 3 == r)

    done, left = stores.rescue(spark.createDataFrame([(1,), (2,), (4,)], "id int"), attempt, "id")
    assert rows(done, "id") == [(1,), (2,), (4,)] and left.isEmpty() and seen == [1, 2]


def test_item_chain_needs_both_answers(spark):
    from lexforge.sources import stores

    items = spark.createDataFrame([("1", "A"), ("2", "B"), ("3", "C"), ("4", "D"), ("4", "D"), (None, "E")], "item_id string, doc_number string")
    diagrams = spark.createDataFrame([("1", 200, '{"data": {"k": 1}}'), ("2", 500, None), ("3", 200, "not json"), ("4", 200, "{}")], "item_id string, status int, body string")
    pages = spark.createDataFrame([("1", 200, "<p>"), ("2", 200, "<p>"), ("3", 200, "<b>"), ("9", 200, "x")], "item_id string, status int, body string")
    done, failed = stores.item_chain(items, diagrams, pages)
    assert rows(done, "item_id", "diagram_json", "full_text_html") == [("1", '{"k":1}', "<p>"), ("3", None, "<b>")]
    assert rows(failed, "item_id", "failed_at_step", "reason") == [("2", "diagram", "status 500"), ("4", "page", "no answer")]


def test_sinks(spark, tmp_path):
    from lexforge.sources import stores

    stores.append_failed(spark.createDataFrame([("7", "page")], "item_id string, failed_at_step string"), str(tmp_path / "failed"))
    stores.append_failed(spark.createDataFrame([("8", "diagram")], "item_id string, failed_at_step string"), str(tmp_path / "failed"))
    assert rows(spark.read.json(str(tmp_path / "failed")), "item_id") == [("7",), ("8",)]
    for turn in ([("s", "user", "hỏi"), ("t", "user", "khác")], [("s", "assistant", "đáp")]):
        stores.append_transcript(spark.createDataFrame(turn, "session_id string, role string, content string"), str(tmp_path / "chat"))
    assert rows(stores.read_transcript(spark, str(tmp_path / "chat")), "session_id", "turn", "content") == [("s", 1, "hỏi"), ("s", 2, "đáp"), ("t", 1, "khác")]
    stores.write_markdown(spark.createDataFrame([("5", "# Điều"), ("6/7", None)], "doc_id string, md string"), str(tmp_path / "md"))
    assert {p.name: p.read_text() for p in (tmp_path / "md").iterdir()} == {"5.md": "# Điều", "6_7.md": ""}
    items = spark.createDataFrame([(f"{i:02d}" if i != 3 else "x" * 30,) for i in range(12)], "id string")
    bad, n = stores.insert_batches(items, str(tmp_path / "in"), {"id": F.length("id") < 10}, "id", 5)
    assert n == 11 and [r.id for r in bad.collect()] == ["x" * 30]
    assert rows(spark.read.parquet(str(tmp_path / "in")).groupBy("batch_no").count(), "batch_no", "count") == [(0, 5), (1, 5), (2, 1)]


def test_listing_takes_filters(spark):
    def fetch(page, size, filters):
        rows = [{"id": str(i), "kind": "NĐ" if i % 2 else "TT"} for i in range(10)]
        for name, (how, value) in filters.items():
            rows = [r for r in rows if (r[name] in value if how == "in" else value in r[name])]
        return [json.dumps(r) for r in rows[(page - 1) * size : page * size]], len(rows)

    paged.register(spark, "typed_listing", fetch, ("id", "kind"))
    df = spark.read.format("typed_listing").option("pageSize", 2).load().where("kind = 'NĐ' and id in ('1', '3', '4')")
    assert rows(df, "id", "page") == [("1", 1), ("3", 1)]

    def broken(page, size, filters):
        raise OSError("no such host")

    paged.register(spark, "broken_listing", broken)
    assert [(r.page, r.item, r.error) for r in spark.read.format("broken_listing").load().collect()] == [(1, None, "no such host")]


def test_search_keeps_a_running_best(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(vectors, "QUERY_ROWS", 7)
    monkeypatch.setattr(vectors, "CORPUS_ROWS", 13)
    r = np.random.default_rng(2)
    x, y = r.integers(-2, 3, (20, 4)), r.integers(-2, 3, (300, 4))
    q = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "query_id bigint, vec array<float>")
    c = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(y)], "id bigint, vec array<float>").coalesce(1)
    want = {}
    for i, v in enumerate(x):
        if v.any():
            sim = [(-round(float(v @ w / np.sqrt((v @ v) * (w @ w))), 6), j) for j, w in enumerate(y) if w.any()]
            want[i] = [j for _, j in sorted(sim)[:3]]
    got = {}
    for g in vectors.search(q, c, 3, 4).orderBy("query_id", "rank").collect():
        got.setdefault(g.query_id, []).append(g.id)
    assert got == want
