"""Operators of a training-data pipeline: cleaning, deduplication, tokenising, packing, sharding and archiving of documents."""
