"""Imports every operator, so that QUERIES is complete."""

from . import (byte_bpe, collocations, conversation_repair, decontaminate, line_dedup, lm_score, lsh_forest, mil_quality, packing, pivot_search,  # noqa: F401
               pu_toxicity, secret_scan, suffix_dedup)
from .common import QUERIES  # noqa: F401
