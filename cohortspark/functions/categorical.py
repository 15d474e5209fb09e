"""Categorical (F3) and text (F4) normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of "missing" in categorical columns (case-sensitive, no trim).
MISSING_CATEGORY_TOKENS = ["nan", "None", ""]
NOTEBOOK_MISSING_CATEGORY_TOKENS = ["nan", "None"]


def normalize_categorical(col: Column | str, unknown_token: str = "Unknown",
                          variant: str = "package") -> Column:
    """null / 'nan' / 'None' / '' (and a literal 'Unknown') → ``unknown_token``."""
    c = (F.col(col) if isinstance(col, str) else col).cast("string")
    tokens = MISSING_CATEGORY_TOKENS if variant == "package" else NOTEBOOK_MISSING_CATEGORY_TOKENS
    return (F.when(c.isNull() | c.isin(*tokens) | (c == F.lit("Unknown")), F.lit(unknown_token))
            .otherwise(c))


def normalize_text(col: Column | str) -> Column:
    """null → '' ; everything else kept as its string form."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit(""))
