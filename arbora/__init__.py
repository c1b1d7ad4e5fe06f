"""arbora: product-taxonomy data work as Spark DataFrame jobs.

Sub-packages
------------
sources    readers and writers for offers, quads, configs, results, corpora
functions  column-expression builders for text cleaning and key parsing
operators  taxonomy, metrics, classification, offers, splits, corpus, runs
plans      stand-in tables over the test data and the registered queries
streaming  incremental quad extraction with Structured Streaming
"""

__version__ = "0.1.0"
