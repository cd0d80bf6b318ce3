"""Training-data operators: deduplication, packing, scoring, tokenising and media columns.

Nothing outside this subpackage imports it; the registered queries are in :mod:`cuemill.llm.queries`.
"""
