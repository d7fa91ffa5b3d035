"""Operators of a training-data pipeline over the ``documents`` and ``pages``
tables: source mixing, SimHash near-dedup, sharding, language ID, packing,
quality rules, LM scoring, HTML extraction, exact dedup and PII spans.

Nothing else in the library imports this subpackage.
"""
