"""Registered queries of the training-data operators: name -> (callable, DuckDB text or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from memjoin.llm import decontaminate, edit_prints, exact_dedup, licenses, merkle, packing, periods, perplexity, phrases, pii, repeats, sharding, simhash

Query = Callable[[SparkSession, str], DataFrame]

ENTRIES: dict[str, tuple[Query, str | None]] = {
    "op1_exact_dedup": (exact_dedup.op1_exact_dedup, exact_dedup.OP1_SQL),
    "op2_sharding": (sharding.op2_sharding, sharding.OP2_SQL),
    "op3_packing": (packing.op3_packing, None),
    "op4_quality": (perplexity.op4_quality, None),
    "op5_repeated_phrases": (phrases.op5_repeated_phrases, None),
    "op6_suffix_repeats": (repeats.op6_suffix_repeats, None),
    "op7_simhash": (simhash.op7_simhash, None),
    "op8_pii": (pii.op8_pii, None),
    "op9_decontaminate": (decontaminate.op9_decontaminate, None),
    "op10_licenses": (licenses.op10_licenses, None),
    "op11_periodic_runs": (periods.op11_periodic_runs, None),
    "op12_edit_fingerprints": (edit_prints.op12_edit_fingerprints, None),
    "op13_merkle_manifest": (merkle.op13_merkle_manifest, merkle.OP13_SQL),
}


def queries() -> dict[str, Query]:
    return {name: run for name, (run, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ENTRIES.items() if sql is not None}
