"""Operators of a training-data pipeline: filtering, deduplication, scanning,
packing, search and scoring of whole corpora. Nothing outside this subpackage
imports it."""
