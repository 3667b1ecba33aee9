"""Display values: rounded once, half up, from exact decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit and decimals of a displayed quantity.
MONEY, ENERGY, PRICE = ("GBP", 2), ("kWh", 3), ("pence per kWh", 3)


def displayed(value: Column, kind: tuple[str, int]) -> Column:
    """Struct of exact (text), unit and display (rounded once); null parts for a null value."""
    unit, places = kind
    return F.struct(value.cast("string").alias("exact"), F.lit(unit).alias("unit"), F.round(value, places).cast(f"decimal(38,{places})").alias("display"))


def ratio(part: Column, whole: Column, places: int, scale: int = 10) -> Column:
    """part / whole to ``places`` decimals, rounded once, half away from zero, from the exact values.

    Both have up to ``scale`` decimals and 27 digits; null where whole is 0. The quotient is taken in
    integers with its remainder, since a decimal division is itself rounded.
    """
    sign = F.when((part < 0) != (whole < 0), -1).otherwise(1)
    kind = f"decimal(27,{scale})"
    p, w = F.abs(part.cast(kind)), F.nullif(F.abs(whole.cast(kind)), F.lit(0).cast(kind))
    grown = p.cast(kind) * F.lit(10**places).cast(f"decimal({places + 1},0)")
    quotient = F.call_function("div", grown, w)
    rest = grown - quotient.cast("decimal(10,0)") * w
    return (sign * (quotient + F.when(rest * 2 >= w, 1).otherwise(0))).cast("decimal(20,0)") * F.lit(f"1e-{places}").cast(f"decimal({places + 1},{places})")


def share_percent(part: Column, whole: Column, places: int = 1, scale: int = 10) -> Column:
    """part / whole in percent to ``places`` decimals, rounded once; null where whole is 0: undefined, not zero."""
    return (ratio(part, whole, places + 2, scale) * 100).cast(f"decimal(20,{places})")


def band_order(band: Column, first: tuple[str, ...] = ("Low", "Normal", "High")) -> Column:
    """A sort key that puts the named bands in their order and all others after them."""
    at = F.array_position(F.array(*map(F.lit, first)), band)
    return F.when(at > 0, at).otherwise(len(first) + 1)
