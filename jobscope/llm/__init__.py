"""Training-data operators: quality, search, language, PII, dedup, toxicity, sharding, URLs, packing, decontamination.

Nothing outside this subpackage imports it.
"""
