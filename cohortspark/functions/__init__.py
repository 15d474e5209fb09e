"""Column expressions (JVM-side, codegen friendly): no Python UDFs here."""

from cohortspark.functions.age import parse_age
from cohortspark.functions.categorical import normalize_categorical, normalize_text
from cohortspark.functions.geo import extract_us_states, n_us_regions, state_region_map
from cohortspark.functions.numeric import (
    clip01, cosine_similarity, dot, l2_norm, max_abs_z, nan_to_null, sigmoid,
)
from cohortspark.functions.text import WHITESPACE_CLASS, merge_text, strip_ws

__all__ = [
    "parse_age", "normalize_categorical", "normalize_text", "extract_us_states",
    "n_us_regions", "state_region_map", "clip01", "cosine_similarity", "dot", "l2_norm",
    "max_abs_z", "nan_to_null", "sigmoid", "WHITESPACE_CLASS", "merge_text", "strip_ws",
]
