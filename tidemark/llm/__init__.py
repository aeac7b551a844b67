"""Training-data operators: deduplication, filters, scoring, mixing and packing.

Nothing outside this package and ``corpus_pipeline.py`` imports it.
"""
