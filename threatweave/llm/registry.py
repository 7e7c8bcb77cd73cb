"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from .centroids import OP12_SQL, op12_centroids
from .chunk_dedup import op5_chunk_dedup
from .decontaminate import OP6_SQL, op6_decontamination
from .divergence import OP13_SQL, op13_source_divergence
from .kneser_ney import op10_kneser_ney
from .licenses import op8_licences
from .minhash import OP2_SQL, op2_minhash_near_dedup
from .packing import op9_packing
from .pii import op1_pii
from .quality_rules import op4_quality_rules
from .sharding import op7_kd_sharding
from .token_files import op3_token_files
from .toxicity import op11_toxicity

QUERIES = {
    "op1_pii": op1_pii,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_token_files": op3_token_files,
    "op4_quality_rules": op4_quality_rules,
    "op5_chunk_dedup": op5_chunk_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_kd_sharding": op7_kd_sharding,
    "op8_licences": op8_licences,
    "op9_packing": op9_packing,
    "op10_kneser_ney": op10_kneser_ney,
    "op11_toxicity": op11_toxicity,
    "op12_centroids": op12_centroids,
    "op13_source_divergence": op13_source_divergence,
}
SQL: dict[str, str] = {"op2_minhash_near_dedup": OP2_SQL, "op6_decontamination": OP6_SQL, "op12_centroids": OP12_SQL, "op13_source_divergence": OP13_SQL}
