"""Check queries of this subpackage and their DuckDB text."""

from __future__ import annotations

from . import (
    bpe,
    clusters,
    divergence,
    factorisation,
    lines,
    minhash,
    mixing,
    packing,
    ppm,
    relative_lz,
    repetition,
    run_index,
    subspace,
)

QUERIES = {
    "op1_repetition": repetition.op1_repetition,
    "op2_relative_lz": relative_lz.op2_relative_lz,
    "op3_subspace": subspace.op3_subspace,
    "op4_run_index": run_index.op4_run_index,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_factorisation": factorisation.op6_factorisation,
    "op7_ppm_language": ppm.op7_ppm_language,
    "op8_cost_packing": packing.op8_cost_packing,
    "op9_minhash_postings": minhash.op9_minhash_postings,
    "op10_fuzzy_lines": lines.op10_fuzzy_lines,
    "op11_divergence_tree": divergence.op11_divergence_tree,
    "op12_sainte_lague": mixing.op12_sainte_lague,
    "op13_laesa_clusters": clusters.op13_laesa_clusters,
}
ORACLES: dict[str, str] = {
    "op2_relative_lz": relative_lz.ORACLE,
    "op9_minhash_postings": minhash.ORACLE,
    "op11_divergence_tree": divergence.ORACLE,
    "op12_sainte_lague": mixing.ORACLE,
    "op13_laesa_clusters": clusters.ORACLE,
}
