"""The queries of this subpackage by name, with a DuckDB oracle where SQL expresses one."""

from __future__ import annotations

import corpus_pipeline
from tagplane.llm import chat, collocations, decontamination, divergence, language_model, licenses, mixing, near_dups, quality_model, quality_rules, sharding, token_files, urls

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_elias_fano": language_model.op1_elias_fano,
    "op2_weak_rules": quality_rules.op2_weak_rules,
    "op3_bottom_k": near_dups.op3_bottom_k,
    "op4_fingerprinted_chat": chat.op4_fingerprinted_chat,
    "op5_link_trust": urls.op5_link_trust,
    "op6_patience": licenses.op6_patience,
    "op7_factorisation": quality_model.op7_factorisation,
    "op8_template_windows": decontamination.op8_template_windows,
    "op9_raked_mixture": mixing.op9_raked_mixture,
    "op10_virtual_slots": sharding.op10_virtual_slots,
    "op11_suffix_collocations": collocations.op11_suffix_collocations,
    "op12_token_parquet": token_files.op12_token_parquet,
    "op13_wide_terms": divergence.op13_wide_terms,
}
ORACLES: dict[str, str] = {"op4_fingerprinted_chat": chat.OP4_ORACLE, "op11_suffix_collocations": collocations.OP11_ORACLE, "op13_wide_terms": divergence.OP13_ORACLE}
