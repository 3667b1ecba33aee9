"""Column expressions on identifiers and written values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes, as a Java character class.
WHITE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def strip(col: Column) -> Column:
    """Remove Unicode white space from both ends."""
    return F.regexp_replace(col, f"^{WHITE}+|{WHITE}+$", "")


def household_key(col: Column) -> Column:
    """Household id with white space, case, punctuation and part order disregarded.

    ``HH`` and seven digits in any arrangement become ``HH0000000``; other ids keep their
    letters and digits in upper case; null and wordless ids give null.
    """
    digits = F.regexp_replace(col, "[^0-9]", "")
    letters = F.upper(F.regexp_replace(col, "[^A-Za-z]", ""))
    other = F.upper(F.regexp_replace(col, r"[^\p{L}\p{N}]", ""))
    return (
        F.when(col.rlike("^HH[0-9]{7}$"), col)
        .when((letters == "HH") & (F.length(digits) == 7), F.concat(F.lit("HH"), digits))
        .when(other != "", other)
    )
