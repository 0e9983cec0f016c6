"""The queries of this subpackage by name, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from concord.llm import best_fit, binary_output, decontaminate, licenses, near_duplicates, neighbours, packing, phrases, point_in_time, quality, secrets, sharding, token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_virtual_slots": sharding.op1_virtual_slots,
        "op2_token_binary": binary_output.op2_token_binary,
        "op3_inverted_multi_index": neighbours.op3_inverted_multi_index,
        "op4_near_duplicates": near_duplicates.op4_near_duplicates,
        "op5_license_scan": licenses.op5_license_scan,
        "op6_decontamination": decontaminate.op6_decontamination,
        "op7_token_rollups": token_counts.op7_token_rollups,
        "op8_secret_scan": secrets.op8_secret_scan,
        "op9_packing": packing.op9_packing,
        "op10_quality": quality.op10_quality,
        "op11_best_fit_packing": best_fit.op11_best_fit_packing,
        "op12_point_in_time": point_in_time.op12_point_in_time,
        "op13_phrase_collocations": phrases.op13_phrase_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_decontamination": decontaminate.SQL,
        "op8_secret_scan": secrets.SQL,
        "op12_point_in_time": point_in_time.SQL,
        "op13_phrase_collocations": phrases.SQL,
    }
