"""Training-data operators: scoring, deduplication, mixing, counting and packing of documents.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
