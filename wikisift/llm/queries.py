"""The registered queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from wikisift.llm import decontamination, language, lines, mixing, ngram_join, quality, runs, secrets, sharding, suffix_dedup, tokens, toxicity, whitening
from wikisift.llm.oracles import ORACLES

QUERIES = {
    query.__name__: query
    for query in (
        suffix_dedup.op1_suffix_dedup, mixing.op2_mixing, tokens.op3_token_files, ngram_join.op4_ngram_join, lines.op5_line_dedup,
        decontamination.op6_decontamination, secrets.op7_secrets, quality.op8_quality, sharding.op9_sharding, language.op10_language_id,
        toxicity.op11_toxicity, runs.op12_periodic_runs, whitening.op13_whitening,
    )
}

__all__ = ["ORACLES", "QUERIES"]
