"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from snapstats.llm import collocations, decontaminate, langid, packing, pipeline, quality, repeats, runs, secret_scan, sharding, simhash, stream_dedup, suffixes


def queries():
    return {
        "op1_simhash_anchors": simhash.op1_simhash_anchors,
        "op2_best_fit_packing": packing.op2_best_fit_packing,
        "op3_suffix_array_dedup": suffixes.op3_suffix_array_dedup,
        "op4_quality_rules": quality.op4_quality_rules,
        "op5_secret_scan": secret_scan.op5_secret_scan,
        "op6_difference_cover": repeats.op6_difference_cover,
        "op7_line_windows": repeats.op7_line_windows,
        "op8_language_bitmask": langid.op8_language_bitmask,
        "op9_permutation_table": sharding.op9_permutation_table,
        "op10_fm_index_decontamination": decontaminate.op10_fm_index_decontamination,
        "op11_de_bruijn": collocations.op11_de_bruijn,
        "op12_stream_dedup": stream_dedup.op12_stream_dedup,
        "op13_basic_factors": runs.op13_basic_factors,
        "pipeline": pipeline.run,
    }


def oracle_sql():
    return {
        "op4_quality_rules": quality.OP4_SQL,
        "op6_difference_cover": repeats.OP6_SQL,
        "op7_line_windows": repeats.OP7_SQL,
        "op10_fm_index_decontamination": decontaminate.OP10_SQL,
        "op11_de_bruijn": collocations.OP11_SQL,
        "op12_stream_dedup": stream_dedup.OP12_SQL,
    }
