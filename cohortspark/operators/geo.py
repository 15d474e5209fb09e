"""Geography counts from site text (F6-F8, J2) and their guardrails."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.geo import STATE_TO_REGION, extract_us_states, n_us_regions
from cohortspark.schema import NUMERIC_COLS, REQUIRED_GEO_NUMERIC_COLS


def derive_geography(df: DataFrame, *, locations_col: str = "Locations",
                     site_count: str = "distinct") -> DataFrame:
    """Add ``us_states`` (sorted distinct codes), ``n_sites``, ``n_us_states``, ``n_us_regions``.

    ``site_count="distinct"`` is the reference rule (n_sites == n_us_states);
    ``"mentions"`` counts every code occurrence instead.
    """
    states = extract_us_states(F.col(locations_col)) if locations_col in df.columns \
        else F.array().cast("array<string>")
    out = df.withColumn("us_states", states)
    if site_count == "mentions" and locations_col in df.columns:
        n_sites = F.coalesce(F.size(F.regexp_extract_all(
            F.col(locations_col), F.lit(r"\b(" + "|".join(sorted(STATE_TO_REGION)) + r")\b"), 1)),
            F.lit(0))
    else:
        n_sites = F.size("us_states")
    return out.withColumns({
        "n_sites": n_sites.cast("int"),
        "n_us_states": F.size("us_states").cast("int"),
        "n_us_regions": n_us_regions(F.col("us_states")).cast("int"),
    })


def state_region_rollup(df: DataFrame) -> DataFrame:
    """Trials per (region, state): explode the state list, map to region, count."""
    m = F.create_map(*[x for k, v in sorted(STATE_TO_REGION.items()) for x in (F.lit(k), F.lit(v))])
    return (df.select(F.explode("us_states").alias("state"))
              .groupBy(m[F.col("state")].alias("region"), "state")
              .agg(F.count(F.lit(1)).alias("n_trials")))


def geo_guardrails(df: DataFrame) -> dict:
    """One aggregate pass; raise on empty geography, impossible counts or negatives."""
    r = df.agg(F.max("n_sites").alias("max_sites"), F.max("n_us_states").alias("max_states"),
               F.max("n_us_regions").alias("max_regions"),
               F.least(F.min("n_sites"), F.min("n_us_states"), F.min("n_us_regions")).alias("min_any")
               ).first().asDict()
    if r["max_sites"] is None or r["max_sites"] <= 0:
        raise ValueError("no row has a site: geography was not derived")
    if r["max_states"] > 51 or r["max_regions"] > 4:
        raise ValueError(f"more states or regions than there are: {r}")
    if r["min_any"] < 0:
        raise ValueError("a geography count is below zero")
    return r


def numeric_guardrails(df_num: DataFrame, num_cols: Sequence[str] = NUMERIC_COLS) -> dict:
    """The numeric block has the required geography columns, exactly the columns of the schema, and sane counts."""
    lacking = [c for c in REQUIRED_GEO_NUMERIC_COLS if c not in df_num.columns]
    if lacking:
        raise ValueError(f"numeric block lacks geography columns: {lacking}")
    extra, absent = sorted(set(df_num.columns) - set(num_cols)), sorted(set(num_cols) - set(df_num.columns))
    if extra or absent:
        raise ValueError(f"numeric block differs from the schema: not expected {extra}, absent {absent}")
    return geo_guardrails(df_num)
