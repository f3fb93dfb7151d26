"""Queries of the training-data operators and their equivalents in SQL."""

from . import byte_bpe, decontaminate, line_dedup, lm_scoring, minhash_dedup, packing, prefix_trie, quality_rules, resampling, suffix_dedup, token_counts, token_files, url_filters

_MODULES = (line_dedup, token_counts, token_files, suffix_dedup, byte_bpe, minhash_dedup, decontaminate, quality_rules, url_filters, lm_scoring, prefix_trie, resampling, packing)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
