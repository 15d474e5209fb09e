"""Whitespace handling and the merged protocol text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters Python's ``str.isspace`` / ``\s`` treat as
# whitespace, written as one regex class that Java and RE2 both accept.
WHITESPACE_CLASS = (
    r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


# The same characters as a plain set, for character-set trims.
WHITESPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                    + "".join(chr(c) for c in range(0x2000, 0x200B))
                    + "\u2028\u2029\u202f\u205f\u3000")


# For Java only. Beyond ASCII all whitespace is one of two Latin characters or within one range.
_MAYBE_WIDE = (r"[\x{85}\x{a0}]", r"[\x{1680}-\x{3000}]")
# ASCII runs that are not one plain space already; single characters alone make a class that is one table look-up.
_ASCII_CLASS = r"[ \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f]"
_ASCII_RUNS = f"{_ASCII_CLASS}(?:{_ASCII_CLASS}++|(?<! ))"


def strip_ws(col: Column) -> Column:
    """Python ``str.strip()``: drop leading/trailing whitespace of any kind.

    A character-set trim (no regex), so it stays cheap inside codegen.
    """
    return F.trim(col, F.lit(WHITESPACE_CHARS))


def collapse_ws(col: Column) -> Column:
    """Every whitespace run becomes one space, then the ends are trimmed; a single plain space is left as it is."""
    wide = (F.octet_length(col) != F.char_length(col)) & (col.rlike(_MAYBE_WIDE[0]) | col.rlike(_MAYBE_WIDE[1]))
    return F.trim(F.when(wide, F.regexp_replace(col, f"{WHITESPACE_CLASS}+", " ")).otherwise(F.regexp_replace(col, _ASCII_RUNS, " ")))


def merge_text(present: Sequence[str], all_cols: Sequence[str] | None = None) -> Column:
    """Concatenate text columns with a space, collapse whitespace, trim.

    Columns in ``all_cols`` that are absent from ``present`` count as empty
    strings (they still add a separator, which the collapse removes).
    """
    cols = list(all_cols) if all_cols is not None else list(present)
    # by column: a long clean text is not rewritten because of a short one with runs; empty columns leave no separator
    parts = [F.nullif(collapse_ws(F.col(c).cast("string")), F.lit("")) for c in cols if c in present]
    return F.concat_ws(" ", *parts) if parts else F.lit("")
