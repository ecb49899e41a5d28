"""lexforge: a PySpark-native engine for legal-text corpora.

Crawl-state upkeep, page cleaning, heading normalisation, chunking, metadata
enrichment, vector search and graph lookups as DataFrame plans, with the
training-data operators in the optional subpackage ``llm``.
"""

__version__ = "0.1.0"
