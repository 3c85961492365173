"""Training-data operators: mixing, extraction, scans, quality, deduplication, packing, token files, vector search.

Nothing outside this package imports it.  ``voltlake.llm.queries`` holds the registered queries.
"""
