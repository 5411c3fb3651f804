"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import exact_dedup, language_id, license_scan, maxscore, minhash_dedup, packing, pieces, token_store, toxicity, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_sentencepiece_n_best": pieces.op6_sentencepiece_n_best,
    "op7_minhash_dedup": minhash_dedup.op7_minhash_dedup,
    "op8_max_score": maxscore.op8_max_score,
    "op9_token_store": token_store.op9_token_store,
    "op10_language_id": language_id.op10_language_id,
}
SQL = {
    "op1_url_filter": url_filter.ORACLE,
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op8_max_score": maxscore.ORACLE,
}
