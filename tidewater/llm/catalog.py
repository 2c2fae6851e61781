"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, mixing, neardup, pieces, pii, quality, resampling, sharding, topk, toxicity, trie, urlfilter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": mixing.query,
    "op2_pii": pii.query,
    "op3_near_duplicates": neardup.query,
    "op4_pieces": pieces.query,
    "op5_ring_shards": sharding.query,
    "op6_exact_topk": topk.query,
    "op7_toxicity": toxicity.query,
    "op8_url_filter": urlfilter.query,
    "op9_warc": warc.query,
    "op10_fingerprints": fingerprints.query,
    "op11_prefix_trie": trie.query,
    "op12_importance_resampling": resampling.query,
    "op13_quality_rules": quality.query,
    # what SQL can tell of operators that it can't express as a whole; the operators run whole
    "pii_base_spans": pii.base_query,
    "shard_counts": sharding.counts_query,
    "url_rules": urlfilter.rules_query,
    "fingerprint_edits": fingerprints.edits_query,
    "quality_base": quality.base_query,
}

ORACLES: dict[str, str] = {
    "op1_mix_sources": mixing.SQL,
    "op6_exact_topk": topk.SQL,
    "op9_warc": warc.SQL,
    "op11_prefix_trie": trie.SQL,
    "op12_importance_resampling": resampling.SQL,
    "pii_base_spans": pii.BASE_SQL,
    "shard_counts": sharding.COUNTS_SQL,
    "url_rules": urlfilter.RULES_SQL,
    "fingerprint_edits": fingerprints.EDITS_SQL,
    "quality_base": quality.BASE_SQL,
}
