"""tessella - a PySpark-native engine for document-retrieval analytics.

Core subpackages
----------------
sources    readers with explicit schemas (chunks, lessons, logs, markdown, HTML)
functions  column expressions shared by the operators (text, vectors, buckets)
operators  relational and analytical operators on DataFrames
plans      named queries over the test tables with their SQL twins
streaming  Structured Streaming forms of the log operators

``tessella.llm`` holds the training-data operators. Nothing outside that
folder imports it, so it can be removed as a whole.
"""

__version__ = "0.1.0"
