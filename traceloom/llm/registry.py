"""The registered queries of this subpackage. Those without SQL can't be written as SQL that runs on whole tables in
reasonable time, so the tests hold them against brute force instead."""

from __future__ import annotations

from . import hard_negatives, merkle_manifest, norm_buckets
from .dp_bpe import op9_dp_bpe
from .gam_quality import op2_gam_quality
from .hard_negatives import op12_hard_negatives
from .kmeans_tree import op1_kmeans_tree
from .lpf_dedup import op8_lpf_dedup
from .merkle_manifest import op13_merkle_manifest
from .mixing_lm import op10_mixing_lm
from .norm_buckets import op11_norm_buckets
from .order_minhash import op5_order_minhash
from .pattern_packing import op3_pattern_packing
from .rp_forest import op6_rp_forest
from .stratified_shards import op4_stratified_shards
from .suffix_tree_dedup import op7_suffix_tree_dedup

QUERIES = {f.__name__: f for f in (op1_kmeans_tree, op2_gam_quality, op3_pattern_packing, op4_stratified_shards, op5_order_minhash, op6_rp_forest, op7_suffix_tree_dedup, op8_lpf_dedup, op9_dp_bpe, op10_mixing_lm, op11_norm_buckets, op12_hard_negatives, op13_merkle_manifest)}
ORACLES: dict[str, str] = {"op11_norm_buckets": norm_buckets.ORACLE, "op12_hard_negatives": hard_negatives.ORACLE, "op13_merkle_manifest": merkle_manifest.ORACLE}
