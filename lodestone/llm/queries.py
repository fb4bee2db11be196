"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import classlm, decontam, licenses, minhash, packing, quality, sharding, substring, suffixes, urlfilter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_near_dedup": minhash.query,
        "op2_lm_scoring": classlm.query,
        "op3_packing": packing.query,
        "op4_substring_dedup": substring.query,
        "op5_url_filters": urlfilter.query,
        "op6_suffix_array_dedup": suffixes.query,
        "op7_decontamination": decontam.query,
        "op8_license_scans": licenses.query,
        "op9_quality_rules": quality.query,
        "op10_sharding": sharding.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_near_dedup": minhash.sql(), "op5_url_filters": urlfilter.sql(), "op8_license_scans": licenses.sql()}
