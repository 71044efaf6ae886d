"""The registered queries of this subpackage, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, divergence, flatgraph, langid, lmscore, media, mixing, simhash, tokens, toxicity, url_filter, veccodes

QUERIES = {
    "op1_lm_scores": lmscore.query,
    "op2_simhash": simhash.query,
    "op3_url_filter": url_filter.query,
    "op4_language_id": langid.query,
    "op5_media_columns": media.query,
    "op6_token_files": tokens.query_token_files,
    "op7_decontamination": decontaminate.query,
    "op8_toxicity": toxicity.query,
    "op9_separator_scan": tokens.query_separator_scan,
    "op10_mixing": mixing.query,
    "op11_source_divergence": divergence.query,
    "op12_embedding_near_dedup": flatgraph.query,
    "op13_vector_codes": veccodes.query,
}

ORACLES = {"op3_url_filter": url_filter.oracle(), "op11_source_divergence": divergence.oracle(), "op12_embedding_near_dedup": flatgraph.oracle(), "op13_vector_codes": veccodes.oracle()}
