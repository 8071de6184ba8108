"""Operators for training-data corpora and their registered queries."""

from cumulus.llm import bpe, divergence, embedding_dedup, hard_negatives, langid, line_dedup, lm_score, mixing, ngram_join, packing, sharding, topk, toxicity  # noqa: F401
from cumulus.llm.common import QUERIES, SQL  # noqa: F401
