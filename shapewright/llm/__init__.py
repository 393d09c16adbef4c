"""Training-data operators: deduplication, packing, decontamination, language
identification, URL filtering, token counting, WARC, HTML text and sharding.

Nothing outside this subpackage imports it; its queries are in ``queries``.
"""
