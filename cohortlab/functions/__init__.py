"""Column-level functions (JVM built-ins only; no Python UDFs)."""

from cohortlab.functions.columns import (
    band,
    clip_lower,
    hash_key,
    in_test_split,
    map_values,
    ratio_feature,
    strip_ws,
    title_case,
)

__all__ = [
    "band",
    "clip_lower",
    "hash_key",
    "in_test_split",
    "map_values",
    "ratio_feature",
    "strip_ws",
    "title_case",
]
