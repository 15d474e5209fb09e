"""Free-form age → years (F1 package rule, F2 notebook rule)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.functions.text import strip_ws

# Unit tokens deleted in this order, each as lower, Capitalised
# and UPPER case; characters stripped from the left and right edges.
AGE_UNIT_TOKENS = ["years", "year", "yrs", "yr", "y"]
AGE_LEFT_STRIP = "><=~+ "
AGE_RIGHT_STRIP = "+ "
MISSING_AGE_WORDS = ["nan", "none", "null"]

# A plain decimal literal as Python's float() reads it (underscores between digits).
_DIGITS = r"\d+(_\d+)*"
NUMBER_PATTERN = rf"^[+-]?({_DIGITS}\.?({_DIGITS})?|\.{_DIGITS})([eE][+-]?{_DIGITS})?$"
INF_WORDS = ["inf", "+inf", "infinity", "+infinity"]
NEG_INF_WORDS = ["-inf", "-infinity"]


def to_float(s: Column, stripped: bool = False) -> Column:
    """Python ``float(s)`` for a string column; null where it would raise or give NaN."""
    if not stripped:
        s = strip_ws(s)
    low = F.lower(s)
    return (
        F.when(s.rlike(NUMBER_PATTERN), F.replace(s, F.lit("_"), F.lit("")).cast("double"))
        .when(low.isin(*INF_WORDS), F.lit(float("inf")))
        .when(low.isin(*NEG_INF_WORDS), F.lit(float("-inf")))
        .otherwise(F.lit(None).cast("double"))
    )


def _forms(variant: str) -> list[str]:
    if variant == "package":
        return [f for tok in AGE_UNIT_TOKENS for f in (tok, tok.capitalize(), tok.upper())]
    if variant == "notebook":
        return list(NOTEBOOK_AGE_UNIT_TOKENS)
    raise ValueError(f"unknown parse_age variant {variant!r}")


def _stage_strip(c: Column, variant: str) -> Column:
    return strip_ws(c.cast("string")) if variant == "package" else c.cast("string")


def _stage_clean(s: Column, variant: str) -> Column:
    cleaned = s
    for form in _forms(variant):
        cleaned = F.replace(cleaned, F.lit(form), F.lit(""))
    cleaned = strip_ws(cleaned)
    if variant == "package":
        cleaned = F.rtrim(F.ltrim(cleaned, F.lit(AGE_LEFT_STRIP)), F.lit(AGE_RIGHT_STRIP))
    return strip_ws(cleaned)  # float() ignores surrounding whitespace


def _stage_value(s: Column, cleaned: Column) -> Column:
    missing = s.isNull() | (s == "") | F.lower(s).isin(*MISSING_AGE_WORDS)
    return F.when(missing, F.lit(None).cast("double")).otherwise(to_float(cleaned, stripped=True))


def _numeric(c: Column) -> Column:
    d = c.cast("double")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def parse_age(col: Column | str, data_type: T.DataType | None = None,
              variant: str = "package") -> Column:
    """Age in years as one Column expression (handy for small inputs).

    For tables prefer :func:`with_parsed_ages`, which stages the rule in
    three projections so the long replace chain is evaluated once per row
    and every stage stays inside whole-stage codegen.
    """
    c = F.col(col) if isinstance(col, str) else col
    if data_type is not None and isinstance(data_type, T.NumericType):
        return _numeric(c)
    s = _stage_strip(c, variant)
    return _stage_value(s, _stage_clean(s, variant))


def with_parsed_ages(df, sources: dict[str, str], variant: str = "package"):
    """Add parsed-years columns: ``sources`` maps output name → input column.

    Numbers are cast directly (NaN → null); strings go through the token rule.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric = {o: i for o, i in sources.items() if isinstance(types[i], T.NumericType)}
    text = {o: i for o, i in sources.items() if o not in numeric}
    out = df.withColumns({o: _numeric(F.col(f"`{i}`")) for o, i in numeric.items()}) if numeric else df
    if not text:
        return out
    out = out.withColumns({f"_s_{o}": _stage_strip(F.col(f"`{i}`"), variant) for o, i in text.items()})
    out = out.withColumns({f"_c_{o}": _stage_clean(F.col(f"_s_{o}"), variant) for o in text})
    out = out.withColumns({o: _stage_value(F.col(f"_s_{o}"), F.col(f"_c_{o}")) for o in text})
    return out.drop(*[f"_{p}_{o}" for o in text for p in "sc"])


# Fixed value: the notebook's unit list, each removed once as written
# (no case forms, no sign stripping in that variant).
NOTEBOOK_AGE_UNIT_TOKENS = ["Years", "Year", "years", "year", "yrs", "yr", "Yrs", "Y"]
