"""Operators of a training-data pipeline: filters, language, deduplication, decontamination, licenses, tokens."""
