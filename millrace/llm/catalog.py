"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import hamming, importance, lattice, licenses, minhash, mixing, packing, passages, quality_rules, token_files

QUERIES = {
    f.__name__: f
    for f in (
        importance.op1_importance_resampling,
        minhash.op2_minhash_near_dedup,
        quality_rules.op3_quality_rules,
        passages.op4_passage_dedup,
        hamming.op5_hamming_top_k,
        packing.op6_pack_windows,
        mixing.op7_mix_sources,
        lattice.op8_subword_lattice,
        token_files.op9_token_files,
        licenses.op10_license_scan,
    )
}
ORACLES = {
    "op2_minhash_near_dedup": minhash.ORACLE_MINHASH,
    "op5_hamming_top_k": hamming.ORACLE_HAMMING,
    "op7_mix_sources": mixing.ORACLE_MIX,
}
