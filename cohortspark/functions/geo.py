"""US state extraction from free-form site text."""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F

# US state (and DC) code → Census region.
STATE_TO_REGION = {
    "CT": "Northeast", "ME": "Northeast", "MA": "Northeast", "NH": "Northeast",
    "RI": "Northeast", "VT": "Northeast", "NJ": "Northeast", "NY": "Northeast", "PA": "Northeast",
    "IL": "Midwest", "IN": "Midwest", "MI": "Midwest", "OH": "Midwest", "WI": "Midwest",
    "IA": "Midwest", "KS": "Midwest", "MN": "Midwest", "MO": "Midwest", "NE": "Midwest",
    "ND": "Midwest", "SD": "Midwest",
    "DE": "South", "FL": "South", "GA": "South", "MD": "South", "NC": "South", "SC": "South",
    "VA": "South", "DC": "South", "WV": "South", "AL": "South", "KY": "South", "MS": "South",
    "TN": "South", "AR": "South", "LA": "South", "OK": "South", "TX": "South",
    "AZ": "West", "CO": "West", "ID": "West", "MT": "West", "NV": "West", "NM": "West",
    "UT": "West", "WY": "West", "AK": "West", "CA": "West", "HI": "West", "OR": "West", "WA": "West",
}

# Whole-word match of any code; same pattern text works in Java and RE2.
STATE_PATTERN = r"\b(" + "|".join(sorted(STATE_TO_REGION)) + r")\b"


def state_region_map() -> Column:
    """Literal map column state → region (51 entries, folded into the plan)."""
    return F.create_map(*itertools.chain.from_iterable(
        (F.lit(k), F.lit(v)) for k, v in sorted(STATE_TO_REGION.items())))


def extract_us_states(col: Column | str) -> Column:
    """Distinct state codes found in the text, sorted; null text → empty array."""
    c = F.col(col) if isinstance(col, str) else col
    found = F.regexp_extract_all(c, F.lit(STATE_PATTERN), 1)
    return F.coalesce(F.array_sort(F.array_distinct(found)), F.array().cast("array<string>"))


def n_us_regions(states: Column) -> Column:
    """Number of distinct Census regions among the codes."""
    m = state_region_map()
    regions = F.filter(F.transform(states, lambda s: m[s]), lambda r: r.isNotNull())
    return F.size(F.array_distinct(regions))
