"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bm25, decontam, minhash, pieces, pii, secrets, sharding, suffix_dedup, toxicity, urlfilter

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op10_bm25_search": bm25.op10_bm25_search,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_sharding": sharding.op3_sharding,
    "op4_pii": pii.op4_pii,
    "op5_decontamination": decontam.op5_decontamination,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_minhash": minhash.op7_minhash,
    "op8_sentencepiece": pieces.op8_sentencepiece,
    "op9_url_filter": urlfilter.op9_url_filter,
    "pii_base": pii.pii_base,
}
ORACLE = {
    "op10_bm25_search": bm25.OP10_SQL,
    "op1_suffix_dedup": suffix_dedup.OP1_SQL,
    "op3_sharding": sharding.OP3_SQL,
    "op5_decontamination": decontam.OP5_SQL,
    "op6_secret_scan": secrets.OP6_SQL,
    "op7_minhash": minhash.OP7_SQL,
    "op9_url_filter": urlfilter.OP9_SQL,
    "pii_base": pii.BASE_SQL,
}
