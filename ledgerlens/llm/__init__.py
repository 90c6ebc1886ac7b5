"""Training-data operators: mixing, quality, nearest neighbours, toxicity, packing,
personal data, near and substring deduplication, page extraction, token counts.

Nothing outside this subpackage imports it. ``llm_queries`` registers one query
per operator; ``corpus_pipeline.py`` at the repository top chains five of them.
"""
