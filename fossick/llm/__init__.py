"""Training-data operators: token counts, quality rules, deduplication, secret scans, mixing, tokenising, chat data.

Nothing outside this folder and ``corpus_pipeline.py`` imports it.
"""
