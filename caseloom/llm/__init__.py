"""Operators of a training-data pipeline: filters, deduplication, mixing, tokenizing, packed output."""
