"""Training-data operators: deduplication, extraction, filtering, tokenising, packing and scoring.

Nothing outside this subpackage imports it; ``corpus_pipeline.py`` chains five of its operators.
"""
