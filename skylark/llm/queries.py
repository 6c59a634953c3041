"""Queries and SQL of the training-data operators, for ``__spark_entry__``."""

from __future__ import annotations

from . import ann, decontamination, jaccard_join, mixing, periodic_runs, prefix_trie, quality, secrets_scan, sharding, substring_dedup, suffix_dedup, toxicity, url_filter


def queries():
    return {
        "op1_host_reputation": url_filter.op1_host_reputation,
        "op10_rule_ensemble": quality.op10_rule_ensemble,
        "op8_secret_grammars": secrets_scan.op8_secret_grammars,
        "op9_toxicity": toxicity.op9_toxicity,
        "op2_sampled_splitters": sharding.op2_sampled_splitters,
        "op3_jaccard_join": jaccard_join.op3_jaccard_join,
        "op4_mix_sources": mixing.op4_mix_sources,
        "op6_cross_polytope": ann.op6_cross_polytope,
        "op7_substring_dedup": substring_dedup.op7_substring_dedup,
        "op5_decontaminate": decontamination.op5_decontaminate,
        "op11_prefix_trie": prefix_trie.op11_prefix_trie,
        "op12_periodic_runs": periodic_runs.op12_periodic_runs,
        "op13_suffix_dedup": suffix_dedup.op13_suffix_dedup,
    }


def oracle_sql():
    return {
        "op1_host_reputation": url_filter.OP1_SQL,
        "op7_substring_dedup": substring_dedup.OP7_SQL,
        "op3_jaccard_join": jaccard_join.OP3_SQL,
        "op4_mix_sources": mixing.OP4_SQL,
        "op5_decontaminate": decontamination.OP5_SQL,
        "op11_prefix_trie": prefix_trie.OP11_SQL,
        "op12_periodic_runs": periodic_runs.OP12_SQL,
        "op13_suffix_dedup": suffix_dedup.OP13_SQL,
    }
