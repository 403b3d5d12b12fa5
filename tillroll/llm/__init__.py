"""Operators of a training-data pipeline (quality, dedup, packing, search,
language, tokens).  Nothing outside this package imports it."""
