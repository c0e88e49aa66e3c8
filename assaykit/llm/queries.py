"""Queries of the corpus operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontam, exactdedup, langid, licenses, linededup, mixing, ngram_join, omh, quality, ranked, secrets, sharding, veccodes

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_order_minhash": omh.op3_order_minhash,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_quality_scores": quality.op5_quality_scores,
    "op6_secret_spans": secrets.op6_secret_spans,
    "op7_shard_documents": sharding.op7_shard_documents,
    "op8_line_dedup": linededup.op8_line_dedup,
    "op9_ngram_components": ngram_join.op9_ngram_components,
    "op10_benchmark_hits": decontam.op10_benchmark_hits,
    "op11_ranked_search": ranked.op11_ranked_search,
    "op12_exact_dedup": exactdedup.op12_exact_dedup,
    "op13_vector_codes": veccodes.op13_vector_codes,
}

ORACLE_SQL = {
    "op4_mix_sources": mixing.MIX_SQL.format(docs="documents"),
    "op10_benchmark_hits": decontam.HITS_SQL.format(docs="documents"),
    "op11_ranked_search": ranked.RANKED_SQL,
    "op12_exact_dedup": exactdedup.EXACT_SQL,
    "op13_vector_codes": veccodes.CODES_SQL,
}
