"""Operators of a training-data pipeline: dedup, search, extraction, tokens, sharding, mixing.

Nothing else in the library imports this package; `arbora.llm.queries` holds its
registered queries.
"""
