"""Training-data operators: packing, WARC, near-duplicates, quality, toxicity, fingerprints, tokens.

Nothing outside this subpackage, its tests and ``corpus_pipeline.py`` imports it.
"""
