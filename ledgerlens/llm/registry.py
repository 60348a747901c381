"""The queries of this subpackage and their SQL, for the driver."""

from __future__ import annotations

from . import (
    branch_merge,
    decontamination,
    exact_dedup,
    license_scans,
    ngram_join,
    packed_binary,
    packing,
    periodic_runs,
    quality_classifier,
    quality_rules,
    sharding,
    token_counts,
    toxicity,
)

QUERIES = {
    "op1_packing": packing.query,
    "op2_toxicity": toxicity.query,
    "op3_sharding": sharding.query,
    "op4_license_scans": license_scans.query,
    "op5_quality_rules": quality_rules.query,
    "op6_quality_classifier": quality_classifier.query,
    "op7_token_counts": token_counts.query,
    "op8_packed_binary": packed_binary.query,
    "op9_ngram_join": ngram_join.query,
    "op10_decontamination": decontamination.query,
    "op11_exact_dedup": exact_dedup.query,
    "op12_branch_merge": branch_merge.query,
    "op13_periodic_runs": periodic_runs.query,
}

ORACLE_SQL: dict[str, str] = {
    "op9_ngram_join": ngram_join.SQL,
    "op10_decontamination": decontamination.SQL,
    "op11_exact_dedup": exact_dedup.SQL,
    "op12_branch_merge": branch_merge.SQL,
}
