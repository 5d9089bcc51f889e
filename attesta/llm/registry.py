"""The queries of the training-data operators, one for each."""

from __future__ import annotations

from attesta.llm import bpe, crc_resampling, lattice, line_dedup, media, mixing, packing, quality_rules, resampling, similarity, surrogates, vector_codes, warc

QUERIES = {
    "op1_lattice_score": lattice.query,
    "op2_jaccard_join": similarity.query,
    "op3_avi_shots": media.query,
    "op4_mix_sources": mixing.query,
    "op5_warc": warc.query,
    "op6_bpe": bpe.query,
    "op7_resampling": resampling.query,
    "op8_line_dedup": line_dedup.query,
    "op9_quality_rules": quality_rules.query,
    "op10_surrogates": surrogates.query,
    "op11_vector_codes": vector_codes.query,
    "op12_packing": packing.query,
    "op13_crc_resampling": crc_resampling.query,
}
ORACLES = {
    "op5_warc": warc.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op11_vector_codes": vector_codes.ORACLE,
    "op13_crc_resampling": crc_resampling.ORACLE,
}
