"""The numbered queries, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .op1_sorted_projection import OP1_SQL, op1_sorted_projection
from .op2_packing import op2_best_fit_packing
from .op3_token_counts import op3_token_counts
from .op4_ann import op4_collision_ann
from .op5_secrets import op5_secret_scan
from .op6_mixing import op6_source_mixing
from .op7_minhash import OP7_SQL, op7_minhash_near_dedup
from .op8_language_id import op8_language_id
from .op9_sharding import op9_shard_shuffle
from .op10_lattice_lm import op10_lattice_lm
from .op11_toxicity import op11_toxicity
from .op12_importance import OP12_SQL, op12_importance_resampling
from .op13_hard_negatives import OP13_SQL, op13_hard_negatives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sorted_projection,
        op2_best_fit_packing,
        op3_token_counts,
        op4_collision_ann,
        op5_secret_scan,
        op6_source_mixing,
        op7_minhash_near_dedup,
        op8_language_id,
        op9_shard_shuffle,
        op10_lattice_lm,
        op11_toxicity,
        op12_importance_resampling,
        op13_hard_negatives,
    )
}

#: The others have no SQL: DuckDB has no tokenizer, trained network or random order, and a recall is not SQL; tests/llm holds each of them against a brute-force version, a round trip or held-out labels instead.
ORACLE_SQL: dict[str, str] = {"op1_sorted_projection": OP1_SQL, "op7_minhash_near_dedup": OP7_SQL, "op12_importance_resampling": OP12_SQL, "op13_hard_negatives": OP13_SQL}
