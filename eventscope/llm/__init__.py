"""Operators of a training-data pipeline: one module per operator, nothing else in the library imports them.

=====================  ==========================================================================
module                 method
=====================  ==========================================================================
``token_counts``       edit-aware token counts over per-document trees of pre-tokens
``line_dedup``         winnowing over line hashes, matches extended both ways
``decontamination``    FM-index per training shard, backward search, sampled suffix positions
``toxicity``           label model over many voters, linear classifier on its posteriors
``embedding_dedup``    randomly rotated binary codes with error bounds, exact recheck
``bpe``                BPE of long texts by tree concatenation of halves; decoding
``minhash_dedup``      MinHash with tensored banding, links verified on full sets
``pii``                base patterns plus terms whose co-occurrence discloses an entity
``chat``               chat template with grammar round trip and reversible escapes (SQL only)
``quality_rules``      thresholds per stratum, certified by exact binomial bounds (SQL only)
``hard_negatives``     inverted multi-index, cells visited by half-score bounds
``lexical_search``     best position algorithm over impact lists
``warc``               WARC writer with revisit records and a salvaging reader
=====================  ==========================================================================

``queries`` registers one query per operator and the pipeline.
"""
