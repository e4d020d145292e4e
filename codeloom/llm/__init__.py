"""Training-data operators: deduplication, token counts, media, PII, sharding and packing.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""
