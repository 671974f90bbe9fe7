"""Training-data operators: mixing, dedup, extraction, formatting, packing, search, sharding.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it; the
rest of the library works with the folder deleted.
"""
