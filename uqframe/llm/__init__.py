"""Operators for training-data pipelines: filtering, tokens, packing, archives, scoring,
deduplication and vector search. Nothing else in the library imports this subpackage."""
