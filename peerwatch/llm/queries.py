"""The operators' named queries and their SQL."""

from __future__ import annotations

from peerwatch.llm import chat, exact, forest, kdtree, language, mixing, negatives, packing, quality, secrets, simhash, warc, whitening

QUERIES = {
    "op1_warc_normalise": warc.op1_warc_normalise,
    "op2_simhash_bktree": simhash.op2_simhash_bktree,
    "op3_quality_ftrl": quality.op3_quality_ftrl,
    "op4_kd_shards": kdtree.op4_kd_shards,
    "op5_exact_dedup": exact.op5_exact_dedup,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_chat_format": chat.op8_chat_format,
    "op9_hash_forest": forest.op9_hash_forest,
    "op10_pack_nnls": packing.op10_pack_nnls,
    "op11_whiten_jacobi": whitening.op11_whiten_jacobi,
    "op12_strassen_negatives": negatives.op12_strassen_negatives,
    "op13_language_svm": language.op13_language_svm,
}

ORACLES = {**warc.ORACLES, **exact.ORACLES, **chat.ORACLES, **negatives.ORACLES}
