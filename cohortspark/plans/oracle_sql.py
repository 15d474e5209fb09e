"""Independent DuckDB SQL restatements of the registered queries.

Only used by the correctness gate: DuckDB runs these on the same parquet
tables (views ``orders``, ``lineitem``, ...). They restate each rule in SQL
from the specification, sharing no code path with the Spark side except
the fixed value lists.
"""

from __future__ import annotations

from cohortspark.functions.age import AGE_UNIT_TOKENS, MISSING_AGE_WORDS, NOTEBOOK_AGE_UNIT_TOKENS
from cohortspark.functions.geo import STATE_PATTERN, STATE_TO_REGION
from cohortspark.functions.text import WHITESPACE_CLASS
from cohortspark.schema import CAT_COLS, TEXT_COLS
from cohortspark.sources.trials_view import TRIALS_SQL

W = WHITESPACE_CLASS
NUM_RE = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + W + '+|' + W + '+$')}, '', 'g')"


def parse_age_sql(x: str) -> str:
    s = strip(f"CAST({x} AS VARCHAR)")
    c = s
    for tok in AGE_UNIT_TOKENS:
        for form in (tok, tok.capitalize(), tok.upper()):
            c = f"replace({c}, {q(form)}, '')"
    c = strip(c)
    c = f"regexp_replace({c}, '^[><=~+ ]+', '')"
    c = f"regexp_replace({c}, '[+ ]+$', '')"
    c = strip(c)
    words = ", ".join(q(w) for w in MISSING_AGE_WORDS)
    return (f"(CASE WHEN {s} IS NULL OR {s} = '' OR lower({s}) IN ({words}) THEN NULL "
            f"WHEN regexp_matches({c}, {q(NUM_RE)}) THEN CAST(replace({c}, '_', '') AS DOUBLE) "
            f"WHEN regexp_matches({c}, '(?i)^[+-]?inf(inity)?$') THEN "
            f"CASE WHEN starts_with({c}, '-') THEN CAST('-inf' AS DOUBLE) ELSE CAST('inf' AS DOUBLE) END "
            f"ELSE NULL END)")


def parse_age_notebook_sql(x: str) -> str:
    """Notebook rule: each listed token removed once as written, strip, float()."""
    c = f"CAST({x} AS VARCHAR)"
    for form in NOTEBOOK_AGE_UNIT_TOKENS:
        c = f"replace({c}, {q(form)}, '')"
    c = strip(c)
    return (f"(CASE WHEN regexp_matches({c}, {q(NUM_RE)}) THEN CAST(replace({c}, '_', '') AS DOUBLE) "
            f"WHEN lower({c}) IN ('inf', '+inf', 'infinity', '+infinity') THEN CAST('inf' AS DOUBLE) "
            f"WHEN lower({c}) IN ('-inf', '-infinity') THEN CAST('-inf' AS DOUBLE) ELSE NULL END)")


def region_case(x: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in sorted(STATE_TO_REGION.items()))
    return f"(CASE {x} {whens} END)"


def cat_sql(c: str) -> str:
    return (f"(CASE WHEN {c} IS NULL OR {c} IN ('nan', 'None', '', 'Unknown') "
            f"THEN 'Unknown' ELSE {c} END)")


def merge_text_sql(cols: list[str], present: list[str]) -> str:
    parts = " || ' ' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" if c in present else "''"
                                for c in cols)
    return f"trim(regexp_replace({parts}, {q(W + '+')}, ' ', 'g'), ' ')"


TRIALS_PRESENT_TEXT = [c for c in TEXT_COLS if c != "secondary_outcome_text"]


def cleaned_cte() -> str:
    """trials → parsed → medians → cleaned (+ geography)."""
    cats = ", ".join(f"{cat_sql(c)} AS {c}" for c in CAT_COLS)
    texts = ", ".join((f"coalesce({c}, '') AS {c}" if c in TRIALS_PRESENT_TEXT else f"'' AS {c}")
                      for c in TEXT_COLS)
    states = (f"list_sort(list_distinct(coalesce(regexp_extract_all(Locations, {q(STATE_PATTERN)}, 1), "
              f"[]::VARCHAR[])))")
    return f"""WITH trials AS ({TRIALS_SQL}),
parsed AS (SELECT *, {parse_age_sql('eligibility_min_age')} AS pmin,
                     {parse_age_sql('eligibility_max_age')} AS pmax FROM trials),
med AS (SELECT coalesce(median(pmin), 0e0) AS mmin, coalesce(median(pmax), 100e0) AS mmax FROM parsed),
imp AS (SELECT p.*, least(greatest(coalesce(pmin, mmin), 0e0), 120e0) AS a_lo,
               least(greatest(coalesce(pmax, mmax), 0e0), 120e0) AS a_hi FROM parsed p, med),
cleaned AS (SELECT row_id, copy_no, nct_id, Locations,
    least(a_lo, a_hi) AS eligibility_min_age_yrs, greatest(a_lo, a_hi) AS eligibility_max_age_yrs,
    CAST(pmin IS NULL AS INTEGER) AS min_age_missing, CAST(pmax IS NULL AS INTEGER) AS max_age_missing,
    {cats}, {texts},
    white_pct, black_pct, asian_pct, aian_pct, nhpi_pct, male_pct, female_pct, age65_pct,
    enrollment_count, trial_duration_days,
    {states} AS us_states
  FROM imp),
geo AS (SELECT *, CAST(len(us_states) AS INTEGER) AS n_sites, CAST(len(us_states) AS INTEGER) AS n_us_states,
    CAST(len(list_distinct(list_filter(list_transform(us_states, lambda s: {region_case('s')}), lambda r: r IS NOT NULL))) AS INTEGER) AS n_us_regions
  FROM cleaned)
"""


def split_cte(source: str = "geo", key: str = "nct_id", seed: int = 42,
              variant: str = "round") -> str:
    """Global-rank restatement of the split: row_number over all keys."""
    k = f"coalesce(CAST({key} AS VARCHAR), '__null__')"
    if variant == "round":
        cut1 = "round_even(0.64e0 * n, 0)"
        cut2 = f"{cut1} + round_even(0.16e0 * n, 0)"
    else:
        hold = "ceil(0.2e0 * n)"
        test = f"ceil(0.2e0 * (n - {hold}))"
        cut1 = f"(n - {hold} - {test})"
        cut2 = f"(n - {hold})"
    return f""", keys AS (SELECT DISTINCT {k} AS k, md5('{seed}:' || {k}) AS h FROM {source}),
ranked AS (SELECT k, row_number() OVER (ORDER BY h, k) - 1 AS rn, count(*) OVER () AS n FROM keys),
labels AS (SELECT k, CASE WHEN rn < {cut1} THEN 'train' WHEN rn < {cut2} THEN 'test'
                       ELSE 'holdout' END AS split FROM ranked),
splitted AS (SELECT s.*, l.split FROM {source} s JOIN labels l ON l.k = {k.replace(key, 's.' + key)})
"""
