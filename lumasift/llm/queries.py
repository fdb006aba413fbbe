"""Queries op1 to op13 and the SQL of those that SQL can express."""

from __future__ import annotations

from lumasift.llm import exact_dedup, langid, licenses, merkle, mixing, nearest, ngram_join, packing, secrets, token_files, toxicity, url_filter, whitening


def queries() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.query,
        "op2_nearest": nearest.query,
        "op3_language": langid.query,
        "op4_pack": packing.query,
        "op5_token_files": token_files.query,
        "op6_ngram_join": ngram_join.query,
        "op7_toxicity": toxicity.query,
        "op8_secrets": secrets.query,
        "op9_mix_sources": mixing.query,
        "op10_url_filter": url_filter.query,
        "op11_merkle_manifest": merkle.query,
        "op12_whitening": whitening.query,
        "op13_license_scan": licenses.query,
    }


def oracles() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.ORACLE,
        "op6_ngram_join": ngram_join.ORACLE,
        "op10_url_filter": url_filter.ORACLE,
        "op11_merkle_manifest": merkle.ORACLE,
        "op13_license_scan": licenses.ORACLE,
    }
