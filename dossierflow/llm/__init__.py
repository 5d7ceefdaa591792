"""Operators of a training-data pipeline: dedup, joins, decontamination, extraction, scoring, packing."""
