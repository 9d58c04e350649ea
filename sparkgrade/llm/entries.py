"""The queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, clustering, decontamination, extraction, jaccard, pii, quality, ranked, records, secrets, sharding, toxicity, urls

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_ngram_jaccard": jaccard.op2_ngram_jaccard,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_binary_records": records.op6_binary_records,
    "op7_secrets": secrets.op7_secrets,
    "op8_pii": pii.op8_pii,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_url_filter": urls.op10_url_filter,
    "op11_ranked_search": ranked.op11_ranked_search,
    "op12_delta_lloyd": clustering.op12_delta_lloyd,
    "op13_html_extraction": extraction.op13_html_extraction,
}
ORACLE_SQL = {"op1_sharding": sharding.OP1_SQL, "op2_ngram_jaccard": jaccard.OP2_SQL, "op5_quality_rules": quality.OP5_SQL, "op9_decontamination": decontamination.OP9_SQL, "op10_url_filter": urls.OP10_SQL, "op11_ranked_search": ranked.OP11_SQL, "op12_delta_lloyd": clustering.OP12_SQL, "op13_html_extraction": extraction.OP13_SQL}
