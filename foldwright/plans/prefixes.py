"""Preprocessing prefixes shared between candidate configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.functions.exprs import config_key, project_step

# --- fixed values: the two groups of steps whose output candidates can share
SHARED_GROUPS = {
    "cleaned": ["one_hot_encoder", "imputation"],
    "preprocessed": ["one_hot_encoder", "imputation", "rescaling", "balancing", "feature_preprocessor"],
}


def prefix_keys(candidates: DataFrame, groups: dict[str, list[str]] | None = None, config: str = "config") -> DataFrame:
    """One row per (candidate, prefix group) with the order-free key of the prefix."""
    parts = [
        F.struct(F.lit(name).alias("prefix"), config_key(project_step(config, steps)).alias("prefix_key"))
        for name, steps in (groups or SHARED_GROUPS).items()
    ]
    kept = [c for c in candidates.columns if c != config]
    return candidates.select(*kept, F.explode(F.array(*parts)).alias("_p")).select(*kept, "_p.prefix", "_p.prefix_key")


def prefix_reuse(keys: DataFrame) -> DataFrame:
    """(prefix, prefix_key, candidates, reused): how often a shared prefix would be recomputed."""
    return keys.groupBy("prefix", "prefix_key").agg(F.count(F.lit(1)).alias("candidates"), (F.count(F.lit(1)) - 1).alias("reused"))
