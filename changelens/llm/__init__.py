"""Operations for building training corpora: each module holds one operator, its query and, where SQL can say it, its oracle."""

from __future__ import annotations

from . import centroids, conversation_repair, decontaminate, exact_dedup, grid_join, html_extract, katz, language_id, line_dedup, packing, sharding, simhash, toxicity


def queries():
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_katz_scores": katz.op2_katz_scores,
        "op3_suffix_decontamination": decontaminate.op3_suffix_decontamination,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_simhash": simhash.op5_simhash,
        "op6_language_codes": language_id.op6_language_codes,
        "op7_two_pass_shuffle": sharding.op7_two_pass_shuffle,
        "op8_best_fit_packing": packing.op8_best_fit_packing,
        "op9_min_cut_extraction": html_extract.op9_min_cut_extraction,
        "op10_toxicity_chain": toxicity.op10_toxicity_chain,
        "op11_interval_repair": conversation_repair.op11_interval_repair,
        "op12_rotated_centroids": centroids.op12_rotated_centroids,
        "op13_grid_order_join": grid_join.op13_grid_order_join,
    }


def oracle_sql():
    return {
        "op1_line_dedup": line_dedup.OP1_SQL,
        "op4_exact_dedup": exact_dedup.OP4_SQL,
        "op11_interval_repair": conversation_repair.OP11_SQL,
        "op12_rotated_centroids": centroids.OP12_SQL,
        "op13_grid_order_join": grid_join.OP13_SQL,
    }
