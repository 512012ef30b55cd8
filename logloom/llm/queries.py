"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import decontam, line_dedup, lm_scoring, ngram_join, packing, prefix_trie, quality_rules, sharding, suffix_dedup, token_align, token_output, toxicity, url_filter


def _pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_ngram_join": ngram_join.op5_ngram_join,
    "op6_decontamination": decontam.op6_decontamination,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_packing": packing.op8_packing,
    "op9_token_output": token_output.op9_token_output,
    "op10_lm_scoring": lm_scoring.op10_lm_scoring,
    "op11_line_dedup": line_dedup.op11_line_dedup,
    "op12_token_align": token_align.op12_token_align,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
    "pipeline": _pipeline,
}

ORACLES = {"op7_url_filter": url_filter.ORACLE, "op11_line_dedup": line_dedup.ORACLE, "op13_prefix_trie": prefix_trie.ORACLE}
