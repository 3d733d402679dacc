"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from ledgerlens.llm import bpe, class_lm, decontaminate, embedding_dedup, hard_negatives, language, line_dedup, minhash, packing, periodic_runs, pseudonyms, quality, substring_dedup

QUERIES = {
    "op1_substring": substring_dedup.op1_substring,
    "op2_minhash": minhash.op2_minhash,
    "op3_embedding": embedding_dedup.op3_embedding,
    "op4_language": language.op4_language,
    "op5_pseudonyms": pseudonyms.op5_pseudonyms,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_bpe": bpe.op7_bpe,
    "op8_class_lm": class_lm.op8_class_lm,
    "op9_quality": quality.op9_quality,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_packing": packing.op13_packing,
}

SQL = {
    "op1_substring": substring_dedup.SQL,
    "op2_minhash": minhash.SQL,
    "op3_embedding": embedding_dedup.SQL,
    "op6_line_dedup": line_dedup.SQL,
    "op10_decontaminate": decontaminate.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
}
