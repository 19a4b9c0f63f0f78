"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import context_tree, exact_dedup, filter_audit, jaccard_join, mixing, pieces, pii, quality, ranked_search, secrets, suffix_dedup, toxicity, winnowing

#: Personal data of the given tables are made up; their pseudonyms may be undone.
TABLES_KEY = "key of the test tables"


def pii_of_tables(spark, sf_dir):
    """The query with the key of its setting, else with one for these tables."""
    return pii.op7_pii_pseudonyms(spark, sf_dir, spark.conf.get(pii.KEY_SETTING, None) or TABLES_KEY)


QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_jaccard_join": jaccard_join.op2_jaccard_join,
    "op3_secret_scan": secrets.op3_secret_scan,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_quality": quality.op6_quality,
    "op7_pii_pseudonyms": pii_of_tables,
    "op8_winnow_fingerprints": winnowing.op8_winnow_fingerprints,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_sentencepiece": pieces.op10_sentencepiece,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_ranked_search": ranked_search.op12_ranked_search,
    "op13_context_tree": context_tree.op13_context_tree,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op2_jaccard_join": jaccard_join.ORACLE,
    "op5_mix_sources": mixing.ORACLE,
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
    "op12_ranked_search": ranked_search.ORACLE,
}
