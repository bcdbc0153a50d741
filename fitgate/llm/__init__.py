"""Operators that prepare text for training language models.

Nothing outside this subpackage imports it; it can be deleted whole, together with
``tests/llm`` and ``corpus_pipeline.py``.
"""
