"""Operators for preparing training data: search, archives, extraction,
language ID, decontamination, sharding, PII, deduplication, tokenisation.

Each module holds one operator with its own DataFrame interface;
``queries`` registers one query per operator and the pipeline.
"""
