"""One query for each operator of the engine, over whole tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions import headings as H
from lexforge.functions import text as X
from lexforge.operators import crawlstate as C
from lexforge.operators import enrich, graph, html, retrieve, splitting, vectors
from lexforge.schemas import LEVELS, MAX_LENGTHS
from lexforge.session import table as t
from lexforge.sources import paged, stores
from lexforge.sources.files import count_lines
from lexforge.streaming.ingest import ingest_new_items

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- vector search -------------------------------------------------------------------------------------------------------

_OK = "len({0}) = 64 AND len(list_filter({0}, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter({0}, lambda x: x <> 0)) > 0"
_COS = "round(list_inner_product(q.v, c.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(c.v, c.v))), 6)"
_HITS = f"""
    q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0 AND {_OK.format('embedding')}),
    c AS (SELECT chunk_id AS id, embedding::DOUBLE[] AS v FROM vietlaw_chunks WHERE {_OK.format('embedding')}),
    s AS (SELECT query_id, id, {_COS} AS similarity FROM q, c),
    hits AS (SELECT query_id, id AS chunk_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank
             FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= 3)
"""


def _queries(spark, d):
    return t(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))


@query(f"WITH {_HITS} SELECT query_id, chunk_id, similarity, rank FROM hits")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """Queries against the chunk vectors, best three."""
    corpus = t(spark, d, "vietlaw_chunks").select(F.col("chunk_id").alias("id"), F.col("embedding").alias("vec"))
    return vectors.search(_queries(spark, d), corpus).select("query_id", F.col("id").alias("chunk_id"), "similarity", F.col("rank").cast("long").alias("rank"))


@query(f"""
    WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0),
    c AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
    s AS (SELECT query_id, id, {_COS} AS similarity FROM q, c)
    SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank
    FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= 5""")
def vector_topk_per_query(spark: SparkSession, d: str) -> DataFrame:
    corpus = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return vectors.search(_queries(spark, d), corpus, k=5).select("query_id", "id", "similarity", F.col("rank").cast("long").alias("rank"))


# --- graph ---------------------------------------------------------------------------------------------------------------

_ROWS = """
    g AS (
        SELECT c.chunk_id, c.original_text, c.written_at, coalesce(c.metadata.doc_id, 'Unknown') AS doc_id, coalesce(c.metadata.doc_number, 'N/A') AS doc_number,
            coalesce(c.metadata.effective_date, 'Chưa xác định') AS effective_date, coalesce(c.metadata.hierarchy['Chương'], 'Chương N/A') AS chapter,
            coalesce(c.metadata.hierarchy['Điều'], 'Điều N/A') AS article, coalesce(nullif(trim(v.source_doc), ''), 'Văn bản chưa xác định') AS source_doc
        FROM final_contextual_chunks c LEFT JOIN vietlaw_chunks v ON v.chunk_id = c.chunk_id WHERE c.chunk_id IS NOT NULL)
"""
_DOCS = """
    docs AS (SELECT doc_id, source_doc AS name, doc_number, effective_date FROM g
             QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY written_at DESC NULLS LAST, chunk_id DESC) = 1)
"""


def _graph(spark, d):
    return graph.graph_rows(t(spark, d, "final_contextual_chunks"), t(spark, d, "vietlaw_chunks"))


@query(f"WITH {_ROWS}, {_DOCS} SELECT doc_id, name, doc_number, effective_date FROM docs")
def graph_documents(spark: SparkSession, d: str) -> DataFrame:
    return graph.documents(_graph(spark, d))


@query(f"""WITH {_ROWS}
    SELECT 'chapter' AS label, doc_id, chapter, NULL::VARCHAR AS article, NULL::VARCHAR AS chunk_id FROM (SELECT DISTINCT doc_id, chapter FROM g)
    UNION ALL SELECT 'article', doc_id, chapter, article, NULL FROM (SELECT DISTINCT doc_id, chapter, article FROM g)
    UNION ALL SELECT 'chunk', doc_id, chapter, article, chunk_id FROM (SELECT DISTINCT doc_id, chapter, article, chunk_id FROM g)""")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """All three kinds of edges; chapter and article edges are their nodes' keys."""
    g = _graph(spark, d)
    parts = [("chapter", graph.chapters(g)), ("article", graph.articles(g)), ("chunk", graph.chunk_edges(g))]
    return C.append_union(*[p.withColumn("label", F.lit(n)) for n, p in parts]).select("label", "doc_id", "chapter", "article", "chunk_id")


@query(f"""WITH {_ROWS} SELECT chunk_id, original_text AS text FROM g
    QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY written_at DESC NULLS LAST, original_text DESC NULLS LAST) = 1""")
def graph_chunks(spark: SparkSession, d: str) -> DataFrame:
    return graph.chunk_nodes(_graph(spark, d))


@query(f"""WITH {_ROWS}, {_DOCS}
    SELECT DISTINCT g.chunk_id, d.name AS doc_name, d.doc_number, d.effective_date, g.article, g.chapter, g.doc_id FROM g JOIN docs d USING (doc_id)""")
def graph_path(spark: SparkSession, d: str) -> DataFrame:
    """The path from every stored chunk up to its document."""
    g = _graph(spark, d)
    return graph.paths(g, g)


@query("SELECT 'chunk_id' AS key_name, chunk_id AS key_value, count(*) AS n FROM final_contextual_chunks GROUP BY chunk_id HAVING count(*) > 1 OR chunk_id IS NULL"
       " UNION ALL SELECT 'item_id', item_id, count(*) FROM metadata GROUP BY item_id HAVING count(*) > 1 OR item_id IS NULL")  # fmt: skip
def graph_constraints(spark: SparkSession, d: str) -> DataFrame:
    """Keys that break uniqueness."""
    out = []
    for name, col in (("final_contextual_chunks", "chunk_id"), ("metadata", "item_id")):
        out.append(graph.broken_keys(t(spark, d, name), [col]).select(F.lit(col).alias("key_name"), F.col(col).alias("key_value"), "n"))
    return C.append_union(*out)


_DATE = """CASE WHEN {0} IS NULL OR {0} IN ('', 'N/A', 'None') THEN 'Chưa xác định'
    WHEN len(string_split(string_split({0}, 'T')[1], '-')) = 3
    THEN string_split(string_split({0}, 'T')[1], '-')[3] || '/' || string_split(string_split({0}, 'T')[1], '-')[2] || '/' || string_split(string_split({0}, 'T')[1], '-')[1] ELSE {0} END"""
_CONTEXT = f"""WITH {_HITS}, {_ROWS}, {_DOCS},
    path AS (SELECT DISTINCT g.chunk_id, d.name, d.doc_number, d.effective_date, g.chapter, g.article, g.doc_id FROM g JOIN docs d USING (doc_id)),
    first_path AS (SELECT * FROM path QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY doc_id, chapter, article) = 1),
    ctx AS (SELECT h.query_id, h.rank, h.chunk_id, coalesce(p.name, 'N/A') || ' (Số hiệu: ' || coalesce(p.doc_number, 'N/A') || ')' AS doc_info,
        {_DATE.format("coalesce(p.effective_date, 'Chưa xác định')")} AS effective_date, coalesce(p.article, 'N/A') AS article, v.original_text AS content
        FROM hits h LEFT JOIN first_path p ON p.chunk_id = h.chunk_id LEFT JOIN vietlaw_chunks v ON v.chunk_id = h.chunk_id)"""


@query(_CONTEXT + " SELECT query_id, rank, chunk_id, doc_info, effective_date, article, content FROM ctx")
def search_context(spark: SparkSession, d: str) -> DataFrame:
    """Top chunks of every query with their place in the graph."""
    out = retrieve.search_context(_queries(spark, d), t(spark, d, "vietlaw_chunks"), _graph(spark, d))
    return out.withColumn("rank", F.col("rank").cast("long"))


@query(_CONTEXT + """ SELECT query_id, string_agg('TÀI LIỆU ' || rank || ':' || chr(10) || '- Văn bản: ' || coalesce(doc_info, '') || chr(10) || '- Hiệu lực: ' || coalesce(effective_date, '')
    || chr(10) || '- Điều: ' || coalesce(article, '') || chr(10) || '- Nội dung: ' || coalesce(content, '') || chr(10) || chr(10), '' ORDER BY rank) AS context FROM ctx GROUP BY query_id""")
def prompt_assembly(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.prompts(search_context(spark, d))


# --- crawl state ---------------------------------------------------------------------------------------------------------


@query("""WITH m AS (SELECT item_id, doc_number, CASE WHEN json_type(j) = 'OBJECT' THEN json_extract_string(j, '$.effFrom') END AS eff
        FROM (SELECT *, CASE WHEN json_valid(metadata_api) THEN metadata_api END AS j FROM metadata) WHERE item_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY row_id DESC) = 1),
    d AS (SELECT DISTINCT metadata.doc_id AS doc_id FROM final_contextual_chunks WHERE metadata.doc_id IS NOT NULL)
    SELECT d.doc_id, coalesce(m.doc_number, m.item_id, d.doc_id) AS doc_number, coalesce(m.eff, 'Chưa xác định') AS effective_date FROM d LEFT JOIN m ON m.item_id = d.doc_id""")
def metadata_lookup(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "final_contextual_chunks").select("metadata.doc_id").where("doc_id is not null").distinct()
    return enrich.metadata_lookup(docs, t(spark, d, "metadata"))


@query("SELECT item_id, doc_number, row_id FROM metadata WHERE item_id IS NULL OR item_id NOT IN (SELECT item_id FROM html_files WHERE item_id IS NOT NULL)")
def incremental_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """Listed items whose page isn't stored yet."""
    return C.not_known(t(spark, d, "metadata").select("item_id", "doc_number", "row_id"), t(spark, d, "html_files"), "item_id")


_FAILED = """SELECT item_id, doc_number, attempt, failed_at FROM failed_items WHERE item_id IS NOT NULL AND item_id <> ''
    QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY failed_at DESC NULLS LAST, attempt DESC NULLS LAST, doc_number DESC NULLS LAST) = 1"""


def _failed_order():
    return [F.col(c).desc_nulls_last() for c in ("failed_at", "attempt", "doc_number")]


@query(f"SELECT item_id, doc_number, attempt FROM ({_FAILED}) WHERE item_id NOT IN (SELECT item_id FROM html_files WHERE item_id IS NOT NULL AND full_text_html <> '')")
def failed_minus_success(spark: SparkSession, d: str) -> DataFrame:
    done = t(spark, d, "html_files").where("item_id is not null and full_text_html <> ''")
    return C.failed_set(t(spark, d, "failed_items"), done, "item_id", _failed_order()).select("item_id", "doc_number", "attempt")


@query("""SELECT item_id, CASE WHEN (length(item_id) + attempt + 1) % 3 = 0 THEN 1 WHEN (length(item_id) + attempt + 2) % 3 = 0 AND attempt < 4 THEN 2
    WHEN (length(item_id) + attempt + 3) % 3 = 0 AND attempt < 3 THEN 3 END AS resolved_round FROM (""" + _FAILED + ")")  # fmt: skip
def retry_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Three rounds over the open failures under a stated rule of success."""
    open_ = C.latest(t(spark, d, "failed_items").where("item_id is not null and item_id <> ''"), "item_id", _failed_order())
    least = {1: 99, 2: 4, 3: 3}
    rule = lambda r: ((F.length("item_id") + F.col("attempt") + r) % 3 == 0) & (F.lit(r == 1) | (F.col("attempt") < least[r]))
    return C.retry_rounds(open_, "item_id", rule)


@query("SELECT item_id, doc_number, row_id, batch_no FROM metadata QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY row_id DESC NULLS LAST) = 1")
def last_wins_dedup(spark: SparkSession, d: str) -> DataFrame:
    return C.last_wins(t(spark, d, "metadata").select("item_id", "doc_number", "row_id", "batch_no"), "item_id", "row_id")


@query("SELECT item_id, doc_number, row_id, batch_no FROM metadata QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY row_id ASC NULLS LAST) = 1")
def first_wins_dedup(spark: SparkSession, d: str) -> DataFrame:
    return C.first_wins(t(spark, d, "metadata").select("item_id", "doc_number", "row_id", "batch_no"), "item_id", "row_id")


@query("""SELECT item_id, count(*) AS n_rows, count(DISTINCT origin) AS n_origins, max(doc_number) AS doc_number FROM (
    SELECT item_id, doc_number, 'failed' AS origin FROM failed_items UNION ALL SELECT item_id, doc_number, 'metadata' FROM metadata UNION ALL SELECT item_id, NULL, 'page' FROM html_files) GROUP BY item_id""")
def append_union_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Appended rows of three stores, then one row for each item."""
    tag = lambda name, origin, *cols: t(spark, d, name).select(*cols, F.lit(origin).alias("origin"))
    rows = C.append_union(tag("failed_items", "failed", "item_id", "doc_number"), tag("metadata", "metadata", "item_id", "doc_number"), tag("html_files", "page", "item_id"))
    return rows.groupBy("item_id").agg(F.count("*").alias("n_rows"), F.countDistinct("origin").alias("n_origins"), F.max("doc_number").alias("doc_number"))


@query("""WITH old AS (SELECT item_id, doc_number, row_id FROM metadata WHERE batch_no = 1 AND item_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY row_id DESC) = 1),
    new AS (SELECT item_id, doc_number, row_id FROM metadata WHERE batch_no > 1 AND item_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY row_id DESC) = 1)
    SELECT coalesce(n.item_id, o.item_id) AS item_id, CASE WHEN n.item_id IS NULL THEN o.doc_number ELSE n.doc_number END AS doc_number, coalesce(n.row_id, o.row_id) AS row_id
    FROM old o FULL JOIN new n ON n.item_id = o.item_id""")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """Later batches merged into the first one by item."""
    m = t(spark, d, "metadata").where("item_id is not null").select("item_id", "doc_number", "row_id", "batch_no")
    old, new = (C.last_wins(m.where(c), "item_id", "row_id").drop("batch_no") for c in ("batch_no = 1", "batch_no > 1"))
    return C.upsert(old, new, "item_id")


@query("""SELECT o_orderkey, o_orderdate, p AS position, (p - 1) // 20 + 1 AS page_no, ceil(n / 20.0)::BIGINT AS n_pages FROM (
    SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS p, count(*) OVER () AS n FROM orders)""")
def pagination(spark: SparkSession, d: str) -> DataFrame:
    """Orders newest first, in pages of 20."""
    o = t(spark, d, "orders").select("o_orderkey", "o_orderdate")
    pages = o.agg(X.page_count(F.count("*"), 20).cast("long")).first()[0]
    return C.paginate(o, [F.desc("o_orderdate"), F.asc("o_orderkey")]).withColumn("n_pages", F.lit(pages).cast("long"))


@query("SELECT DISTINCT item_id FROM metadata WHERE item_id IS NOT NULL AND item_id <> ''")
def distinct_ids(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "metadata").where("item_id is not null and item_id <> ''").select("item_id").distinct()


@query("""WITH m AS (SELECT item_id, doc_number, diagram_json FROM metadata WHERE item_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY row_id DESC NULLS LAST) = 1),
    j AS (SELECT m.*, p.item_id IS NOT NULL AND coalesce(p.full_text_html, '') <> '' AS page FROM m LEFT JOIN html_files p ON p.item_id = m.item_id)
    SELECT item_id, doc_number, CASE WHEN diagram_json IS NULL THEN 'diagram' WHEN NOT page THEN 'page' END AS failed_at_step,
    CASE WHEN diagram_json IS NULL THEN 'status 404' WHEN NOT page THEN 'no answer' END AS reason FROM j""")
def item_chain(spark: SparkSession, d: str) -> DataFrame:
    """Items with the answers of their diagram and page look-ups: complete ones, and failed ones with where and why."""
    m = C.last_wins(t(spark, d, "metadata").where("item_id is not null").select("item_id", "doc_number", "diagram_json", "row_id"), "item_id", "row_id")
    diagrams = m.select("item_id", F.when(F.col("diagram_json").isNull(), 404).otherwise(200).alias("status"), F.col("diagram_json").alias("body"))
    pages = t(spark, d, "html_files").where("full_text_html <> ''").select("item_id", F.lit(200).alias("status"), F.col("full_text_html").alias("body"))
    complete, failed = stores.item_chain(m.select("item_id", "doc_number"), diagrams, pages)
    none = F.lit(None).cast("string")
    return complete.select("item_id", "doc_number", none.alias("failed_at_step"), none.alias("reason")).unionByName(failed)


def _listing(path: str):
    """A listing of nations that filters itself: what a remote search does, over a small table."""

    def fetch(page: int, size: int, filters: dict):
        import json

        import pyarrow.parquet as pq

        rows = [r for r in pq.read_table(path, columns=["n_nationkey", "n_name", "n_regionkey"]).to_pylist()]
        for name, (how, value) in filters.items():
            rows = [r for r in rows if (str(r[name]) in value if how == "in" else value in str(r[name]))]
        return [json.dumps(r) for r in rows[(page - 1) * size : page * size]], len(rows)

    return fetch


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 2) AND contains(n_name, 'N')")
def paged_listing(spark: SparkSession, d: str) -> DataFrame:
    """A paged source that takes the filters itself."""
    paged.register(spark, "nation_listing", _listing(f"{d}/nation.parquet"), ("n_nationkey", "n_name", "n_regionkey"))
    got = spark.read.format("nation_listing").option("pageSize", 4).load()
    return got.where(F.col("n_regionkey").isin("1", "2") & F.contains("n_name", F.lit("N"))).select("n_nationkey", "n_name")


# --- projections ---------------------------------------------------------------------------------------------------------

_VALID = "(SELECT *, CASE WHEN json_valid(metadata_api) THEN metadata_api END AS j FROM metadata)"
_J = "CASE WHEN json_type(j) = 'OBJECT' THEN json_extract_string(j, '$.{0}') END"


@query(f"""SELECT row_id, coalesce(item_id, '') AS item_id, coalesce(doc_number, 'Unknown') AS doc_number, coalesce({_J.format('title')}, 'Unknown') AS title,
    coalesce({_J.format('issueDate')}, '') AS issue_date, coalesce(item_id, '') || '.html' AS file_html, CASE WHEN coalesce(diagram_json, '') <> '' THEN coalesce(item_id, '') || '.json' END AS file_diagram FROM {_VALID}""")
def item_projection(spark: SparkSession, d: str) -> DataFrame:
    """Crawl items as metadata records with defaults; no diagram file where there is no diagram."""
    item, j = F.coalesce("item_id", F.lit("")), F.col("metadata_api")
    return t(spark, d, "metadata").select(
        "row_id", item.alias("item_id"), F.coalesce("doc_number", F.lit("Unknown")).alias("doc_number"), F.coalesce(X.json_text(j, "$.title"), F.lit("Unknown")).alias("title"),
        F.coalesce(X.json_text(j, "$.issueDate"), F.lit("")).alias("issue_date"), F.concat(item, F.lit(".html")).alias("file_html"),
        F.when(F.coalesce("diagram_json", F.lit("")) != "", F.concat(item, F.lit(".json"))).alias("file_diagram"),
    )


@query(f"""SELECT row_id, CASE WHEN item_id IS NULL OR item_id = '' THEN 'Unknown_ID' ELSE regexp_replace(item_id, '^{X.SPACE}+|{X.SPACE}+$', '', 'g') END AS clean_id FROM metadata""")
def clean_id(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "metadata").select("row_id", X.clean_id(F.col("item_id")).alias("clean_id"))


@query(f"SELECT chunk_id, written_at, {_DATE.format('metadata.effective_date')} AS effective_date FROM final_contextual_chunks")
def date_prettify(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "final_contextual_chunks").select("chunk_id", "written_at", X.prettify_date(F.col("metadata.effective_date")).alias("effective_date"))


@query(f"SELECT doc_id, regexp_replace(right(text, 500), '^{X.SPACE}+|{X.SPACE}+$', '', 'g') AS tail FROM documents")
def tail_text(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", X.tail(F.col("text")).alias("tail"))


@query("""SELECT chunk_id, written_at, CASE WHEN metadata.doc_number IS NOT NULL AND original_text IS NOT NULL THEN 'Đây là quy định về ' || lower(string_split(string_split(original_text, chr(10))[1], '.')[1]) || ' nằm trong ' || metadata.doc_number || '.' || chr(10) || chr(10)
    || 'Nội dung chi tiết:' || chr(10) || original_text ELSE original_text END AS contextualized_text FROM final_contextual_chunks""")
def contextual_text(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("original_text")
    line = X.template_context(text, F.col("metadata.doc_number"))
    return t(spark, d, "final_contextual_chunks").select("chunk_id", "written_at", X.contextual_text(line, text).alias("contextualized_text"))


@query("""SELECT coalesce(chunk_id, '') AS chunk_id, coalesce(metadata.doc_id, '') AS doc_id, coalesce(metadata.doc_number, 'N/A') AS doc_number, coalesce(metadata.effective_date, 'Chưa xác định') AS effective_date,
    coalesce(to_json(metadata.hierarchy)::VARCHAR, '{}') AS hierarchy, coalesce(original_text, '') AS original_text, coalesce(contextualized_text, '') AS contextualized_text FROM final_contextual_chunks""")
def vector_flatten(spark: SparkSession, d: str) -> DataFrame:
    return enrich.flatten_chunks(t(spark, d, "final_contextual_chunks"))


@query("SELECT chunk_id, list_filter([" + ", ".join(f"CASE WHEN length(coalesce({c}, '')) > {n} THEN '{c}' END" for c, n in MAX_LENGTHS.items()) + "], lambda x: x IS NOT NULL)[1] AS first_reason FROM vietlaw_chunks WHERE "
       + " OR ".join(f"length(coalesce({c}, '')) > {n}" for c, n in MAX_LENGTHS.items()))
def length_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Vector rows whose texts don't fit their columns, with the first reason."""
    _, bad = C.split_rejects(t(spark, d, "vietlaw_chunks"), enrich.length_checks())
    return bad.select("chunk_id", F.get("reasons", 0).alias("first_reason"))


@query("SELECT row_id, list_filter([CASE WHEN NOT coalesce(json_valid(metadata_api), false) THEN 'metadata_api' END, CASE WHEN NOT coalesce(json_valid(diagram_json), false) THEN 'diagram_json' END], lambda x: x IS NOT NULL)[1] AS first_reason"
       " FROM metadata WHERE NOT (coalesce(json_valid(metadata_api), false) AND coalesce(json_valid(diagram_json), false))")  # fmt: skip
def json_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Items set aside for JSON that is missing or invalid; the others go on."""
    ok = lambda c: F.try_parse_json(c).isNotNull()
    _, bad = C.split_rejects(t(spark, d, "metadata"), {c: ok(c) for c in ("metadata_api", "diagram_json")})
    return bad.select("row_id", F.get("reasons", 0).alias("first_reason"))


@query("""SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"""SELECT row_id, {_J.format('title')} AS title FROM {_VALID} WHERE contains({_J.format('title')}, 'đường') AND
    CASE WHEN json_type(j) = 'OBJECT' THEN json_extract_string(j, '$.docType.name') END IN ('NĐ', 'TT', 'QĐ')""")
def search_filter(spark: SparkSession, d: str) -> DataFrame:
    """A listing's filters: an exact phrase in the title and a set of document types."""
    j = F.col("metadata_api")
    return t(spark, d, "metadata").select("row_id", X.json_text(j, "$.title").alias("title"), X.json_text(j, "$.docType.name").alias("kind")).where(F.contains("title", F.lit("đường")) & F.col("kind").isin("NĐ", "TT", "QĐ")).select("row_id", "title")


@query("SELECT row_id, batch_no FROM metadata WHERE row_id IS NOT NULL ORDER BY crawled_at DESC NULLS LAST, row_id LIMIT 20")
def newest_page(spark: SparkSession, d: str) -> DataFrame:
    """The first page of a listing, newest first: a limit is what it is."""
    return t(spark, d, "metadata").where("row_id is not null").select("row_id", "batch_no", "crawled_at").orderBy(F.desc_nulls_last("crawled_at"), "row_id").limit(20).drop("crawled_at")


@query("SELECT item_id, attempt, [500, 404, 429, 503][1 + attempt % 4] AS status, [500, 404, 429, 503][1 + attempt % 4] IN (500, 502, 503, 504, 522, 524, 408, 429) AS retryable FROM failed_items")
def retryable_status(spark: SparkSession, d: str) -> DataFrame:
    status = F.get(F.array(*map(F.lit, (500, 404, 429, 503))), F.col("attempt") % 4)
    return t(spark, d, "failed_items").select("item_id", "attempt", status.alias("status"), status.isin(500, 502, 503, 504, 522, 524, 408, 429).alias("retryable"))  # fixed values: retryable codes


@query("""WITH u AS (SELECT item_id, unnest(regexp_extract_all(full_text_html, 'https?://[^\\s"''<>)]+')) AS url FROM html_files),
    h AS (SELECT item_id, url, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM u) SELECT item_id, url, host, host = 'vanban.example' OR host LIKE '%.vanban.example' AS allowed FROM h""")
def allowed_domains(spark: SparkSession, d: str) -> DataFrame:
    """Links in pages and whether their host is on the list of domains."""
    u = t(spark, d, "html_files").select("item_id", F.explode(F.regexp_extract_all("full_text_html", F.lit("(https?://[^\\s\"'<>)]+)"), F.lit(1))).alias("url"))
    host = F.regexp_extract("url", "^https?://([^/:?#]+)", 1)
    return u.select("item_id", "url", host.alias("host"), ((host == "vanban.example") | host.endswith(".vanban.example")).alias("allowed"))


# --- pages and headings --------------------------------------------------------------------------------------------------


def _nested_replace(column: str, steps: list[tuple[str, str]]) -> str:
    out = column
    for pattern, new in steps:
        out = "regexp_replace({}, '{}', '{}', 'g')".format(out, pattern.replace("'", "''"), new)
    return out


@query(f"SELECT item_id, {_nested_replace('full_text_html', [(p, '') for p in html.furniture_patterns()])} AS stripped FROM html_files")
def html_strip(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "html_files").select("item_id", html.strip_furniture(F.col("full_text_html")).alias("stripped"))


@query(f"SELECT item_id, regexp_extract({_nested_replace('full_text_html', [(p, '') for p in html.furniture_patterns()])}, '{html.BODY}', 1) AS body FROM html_files")
def html_body(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "html_files").select("item_id", html.body_of(html.strip_furniture(F.col("full_text_html"))).alias("body"))


@query()
def html_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Pages as Markdown with their headings normalised."""
    return t(spark, d, "html_files").select("item_id", H.normalize_headings(html.to_markdown(F.col("full_text_html"))).alias("md"))


_STEPS = [("(?im)" + H.heading_pattern(w), rf"{n} \1" + "\n" + r"\2") for w, n in H.HEADINGS]
_ROMAN = ("(?m)" + H.ROMAN, r"## \1. \2")
_BLANK = ("\n{3,}", "\n\n")


@query(f"SELECT chunk_id, written_at, {_nested_replace('original_text', _STEPS)} AS md FROM final_contextual_chunks")
def heading_normalize(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "final_contextual_chunks").select("chunk_id", "written_at", H.promote_headings(F.col("original_text")).alias("md"))


@query(f"SELECT doc_id, {_nested_replace('text', [_ROMAN])} AS md FROM documents")
def roman_heading(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", H.roman_headings(F.col("text")).alias("md"))


@query(f"SELECT doc_id, {_nested_replace('text', [_BLANK])} AS md FROM documents")
def blank_collapse(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", H.collapse_blank_lines(F.col("text")).alias("md"))


# --- splitting -----------------------------------------------------------------------------------------------------------


def _chunk_markdown(spark, d):
    """Each chunk under the headers of its hierarchy, as one Markdown text."""
    c = C.latest(t(spark, d, "final_contextual_chunks").where("chunk_id is not null"), "chunk_id", [F.desc_nulls_last("written_at"), F.desc_nulls_last("original_text")])
    heads = [F.concat(F.lit("#" * i + " "), F.try_element_at("metadata.hierarchy", F.lit(n))) for i, n in enumerate(LEVELS, 1)]
    return c.select("chunk_id", F.concat_ws("\n", *heads, "original_text").alias("md"))


_MD = ("SELECT chunk_id AS id, concat_ws(chr(10), " + ", ".join(f"'{'#' * i} ' || metadata.hierarchy['{n}']" for i, n in enumerate(LEVELS, 1)) + ", original_text) AS md FROM final_contextual_chunks"
       " WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY written_at DESC NULLS LAST, original_text DESC NULLS LAST) = 1")  # fmt: skip
_LINES = f"SELECT id, pos, {splitting.LINE.replace(", ''))", ", '', 'g'))")} AS line FROM (SELECT id, unnest(range(len(string_split(md, chr(10))))) AS pos, unnest(string_split(md, chr(10))) AS line FROM ({_MD}))"


@query(splitting.SECTIONS.format(lines=_LINES, agg="string_agg(line, chr(10) ORDER BY pos)", titles=splitting.titles("last_value({} IGNORE NULLS)")))
def header_sections(spark: SparkSession, d: str) -> DataFrame:
    return splitting.header_sections(_chunk_markdown(spark, d), "chunk_id", "md").withColumn("first_pos", F.col("first_pos").cast("long"))


@query()
def size_split(spark: SparkSession, d: str) -> DataFrame:
    """Documents in pieces of at most 1500 characters."""
    return t(spark, d, "documents").select("doc_id", F.posexplode(splitting.size_split(F.col("text"))).alias("piece_no", "piece"))


@query("SELECT doc_id, CASE WHEN length(text) > 1500 THEN 'split' ELSE 'whole' END AS route, length(text) AS n FROM documents WHERE text IS NOT NULL")
def size_route(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").where("text is not null").select("doc_id", F.when(F.length("text") > splitting.SIZE, "split").otherwise("whole").alias("route"), F.length("text").cast("long").alias("n"))


@query(f"""WITH l AS (SELECT doc_id::VARCHAR AS doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
    n AS (SELECT doc_id, pos + 1 AS chunk_no, regexp_replace(line, '^{X.SPACE}+|{X.SPACE}+$', '', 'g') AS line FROM l)
    SELECT doc_id, chunk_no, doc_id || '_chunk_' || chunk_no AS chunk_id, line FROM n WHERE length(line) > 0""")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    """Lines numbered before blank ones are dropped."""
    lines = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return splitting.number_chunks(lines, "doc_id", ["pos"], "line").select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "chunk_id", "line")


# --- batches, counts, transcripts ----------------------------------------------------------------------------------------


@query("""SELECT (p - 1) // 1000 AS batch_no, count(*) AS n, min(chunk_id) AS first_id, max(chunk_id) AS last_id FROM (
    SELECT chunk_id, row_number() OVER (ORDER BY chunk_id) AS p FROM vietlaw_chunks WHERE chunk_id IS NOT NULL) GROUP BY 1""")
def batching(spark: SparkSession, d: str) -> DataFrame:
    """Batches of 1000 rows in id order, the last one short."""
    p = C.number_rows(t(spark, d, "vietlaw_chunks").where("chunk_id is not null").select("chunk_id"), [F.asc("chunk_id")])
    return p.groupBy(F.floor((F.col("position") - 1) / 1000).alias("batch_no")).agg(F.count("*").alias("n"), F.min("chunk_id").alias("first_id"), F.max("chunk_id").alias("last_id"))


@query("""SELECT batch_no, count(*) AS n_rows, count(DISTINCT item_id) AS n_items, count(*) FILTER (WHERE coalesce(diagram_json, '') = '') AS n_without_diagram,
    sum(count(*)) OVER (ORDER BY batch_no) AS running FROM metadata GROUP BY batch_no""")
def stage_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each batch and their running total over the few batches."""
    from pyspark.sql import Window

    g = t(spark, d, "metadata").groupBy("batch_no").agg(F.count("*").alias("n_rows"), F.countDistinct("item_id").alias("n_items"), F.count(F.when(F.coalesce("diagram_json", F.lit("")) == "", 1)).alias("n_without_diagram"))
    return g.withColumn("running", F.sum("n_rows").over(Window.partitionBy().orderBy("batch_no")))


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS n_lines FROM documents WHERE text IS NOT NULL")
def nonblank_lines(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").where("text is not null").select("doc_id", count_lines(F.col("text")).cast("long").alias("n_lines"))


@query("""SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn, event_type AS role FROM events""")
def chat_history(spark: SparkSession, d: str) -> DataFrame:
    """An append-only transcript: entries of a session numbered in order."""
    from pyspark.sql import Window

    return t(spark, d, "events").select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("turn"), F.col("event_type").alias("role"))


@query("SELECT DISTINCT item_id FROM metadata WHERE item_id IS NOT NULL")
def streaming_ingest(spark: SparkSession, d: str) -> DataFrame:
    """New items of the feed, once each, as a stream to its end."""
    schema = t(spark, d, "metadata").schema
    return ingest_new_items(spark, f"{d}/metadata.parquet*", schema, "item_id").select("item_id")
