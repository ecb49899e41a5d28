"""Operators for training data. Nothing outside this subpackage imports it."""

#: Modules of this subpackage with QUERIES and SQL.
QUERY_MODULES = ("queries_text", "queries_spans", "queries_vectors", "queries_corpus", "queries_split", "queries_markup")
