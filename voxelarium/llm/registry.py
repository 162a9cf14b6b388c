"""Queries of the training-data operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from voxelarium.llm import debruijn, decontaminate, forest, language, mixing, pii, projections, sharding, suffix, urllist

QUERIES = {
    "op1_pareto_mix": mixing.op1_pareto_mix,
    "op2_lsh_forest": forest.op2_lsh_forest,
    "op3_temporal_list": urllist.op3_temporal_list,
    "op4_virtual_slots": sharding.op4_virtual_slots,
    "op5_suffix_dedup": suffix.op5_suffix_dedup,
    "op6_debruijn_dedup": debruijn.op6_debruijn_dedup,
    "op7_pii": pii.op7_pii,
    "op8_sorted_projections": projections.op8_sorted_projections,
    "op9_language": language.op9_language,
    "op10_decontamination": decontaminate.op10_decontamination,
}
ORACLES: dict[str, str] = {
    "op1_pareto_mix": mixing.SQL,
    "op2_lsh_forest": forest.SQL,
    "op3_temporal_list": urllist.SQL,
    "op5_suffix_dedup": suffix.SQL,
    "op6_debruijn_dedup": debruijn.SQL,
    "op8_sorted_projections": projections.SQL,
    "op10_decontamination": decontaminate.SQL,
}
