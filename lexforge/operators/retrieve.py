"""Questions to retrieved context and prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions.text import doc_info, prettify_date
from lexforge.operators import graph, vectors
from lexforge.schemas import NO_DATE, NOT_GIVEN
from lexforge.session import materialize


def search_context(queries: DataFrame, chunk_vectors: DataFrame, rows: DataFrame, k: int = 3, dim: int = 64) -> DataFrame:
    """(query_id, rank, chunk_id, doc_info, effective_date, article, content) of the k best chunks of every query.

    ``chunk_vectors`` has (chunk_id, embedding, original_text); ``rows`` are graph rows. Of several paths to a chunk the first by
    document, chapter and article counts; chunks without a path get defaults.
    """
    hits = vectors.search(queries, chunk_vectors.select(F.col("chunk_id").alias("id"), F.col("embedding").alias("vec")), k, dim)
    # read three times below: k rows a query, kept as a table
    hits = materialize(hits.select("query_id", "rank", F.col("id").alias("chunk_id"), "similarity"), "hits")
    w = Window.partitionBy("chunk_id").orderBy("doc_id", "chapter", "article")
    path = graph.paths(hits, rows).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    text = chunk_vectors.select("chunk_id", F.col("original_text").alias("content"))
    j = hits.join(path, "chunk_id", "left").join(text, "chunk_id", "left")
    missing = F.col("doc_name").isNull()
    return j.select(
        "query_id", "rank", "chunk_id", doc_info(F.when(missing, NOT_GIVEN).otherwise(F.col("doc_name")), F.when(missing, NOT_GIVEN).otherwise(F.col("doc_number"))).alias("doc_info"),
        prettify_date(F.when(missing, NO_DATE).otherwise(F.col("effective_date"))).alias("effective_date"), F.when(missing, NOT_GIVEN).otherwise(F.col("article")).alias("article"), "content",
    )


def context_block():
    """One numbered block of a prompt. Its labels."""
    part = lambda name: F.coalesce(F.col(name), F.lit(""))
    return F.concat(
        F.lit("TÀI LIỆU "), F.col("rank").cast("string"), F.lit(":\n- Văn bản: "), part("doc_info"), F.lit("\n- Hiệu lực: "), part("effective_date"),
        F.lit("\n- Điều: "), part("article"), F.lit("\n- Nội dung: "), part("content"), F.lit("\n\n"),
    )


def prompts(context: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """(query_id, context[, question, prompt]): the blocks of a query in rank order, at most k of them, and the prompt around them."""
    blocks = context.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", context_block().alias("b")))), lambda x: x["b"]), "").alias("context"))
    if questions is None:
        return blocks
    prompt = F.concat(F.lit("Chỉ dựa vào các tài liệu sau, hãy trả lời ngắn gọn và nêu văn bản được trích dẫn.\n\n"), F.coalesce("context", F.lit("")), F.lit("CÂU HỎI: "), F.col("question"))
    return questions.join(blocks, "query_id", "left").withColumn("prompt", prompt)


class Retriever:
    """Search over stored vectors and graph rows with a pluggable ``encode`` (texts to vectors) and ``answer`` (prompts to texts)."""

    def __init__(self, chunk_vectors: DataFrame, rows: DataFrame, encode, answer=None, dim: int = 64):
        self.vectors, self.rows, self.encode, self.answer, self.dim = chunk_vectors, rows, encode, answer, dim

    def search_context(self, questions: list[str], k: int = 3) -> DataFrame:
        spark = self.vectors.sparkSession
        q = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(self.encode(questions))], "query_id bigint, vec array<float>")
        return search_context(q, self.vectors, self.rows, k, self.dim)

    def ask(self, questions: list[str], k: int = 3) -> DataFrame:
        """Questions with their prompts and, given an ``answer``, the answers, in Arrow batches."""
        spark = self.vectors.sparkSession
        q = spark.createDataFrame(list(enumerate(questions)), "query_id bigint, question string")
        out = prompts(self.search_context(questions, k), q)
        if self.answer is None:
            return out
        answer = self.answer

        def run(s):
            import pandas as pd

            return pd.Series([answer(x) for x in s], dtype=object)

        return out.withColumn("answer", F.pandas_udf(run, "string")("prompt"))
