"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, html_text, langid, merkle, mixing, neardup, packing, periodic, quality, secrets, substrings, suffixes, token_files


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_count_min_substrings": substrings.op1,
        "op2_pareto_mix": mixing.op2,
        "op3_ppm_language_id": langid.op3,
        "op4_simhash_fingerprints": fingerprints.op4,
        "op5_best_fit_pack": packing.op5,
        "op6_weak_supervision": quality.op6,
        "op7_suffix_radix_dedup": suffixes.op7,
        "op8_bit_sliced_near_dedup": neardup.op8,
        "op9_arrow_token_files": token_files.op9,
        "op10_crf_main_text": html_text.op10,
        "op11_password_guess_cost": secrets.op11,
        "op12_merkle_manifest": merkle.op12,
        "op13_periodic_runs": periodic.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_pareto_mix": mixing.OP2_SQL,
        "op12_merkle_manifest": merkle.OP12_SQL,
    }
