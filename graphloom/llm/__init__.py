"""Operators for training-data pipelines: deduplication, decontamination, scoring, redaction and tokenisation.

Nothing outside this subpackage imports it.  `queries.py` holds the thin queries over whole tables.
"""
