"""Operators for large-scale text-corpus preparation.

Nothing else in the package imports this subpackage; it may be removed as a
whole together with ``tests/llm`` and ``corpus_pipeline.py``.
"""
