"""Rules on prices and pictures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How far a discount in tenths may be off, strict before lenient.
TOLERANCES = (0.1, 0.5)
SMALL_IMAGE, LARGE_IMAGE, LEAST_SIDE = 15_000, 100_000, 250


def classify_prices(a: Column, b: Column, discount: Column) -> Column:
    """What two prices are, given a discount in tenths: ``original,saved`` or ``original,price``, in the order of the input."""
    high, low = F.greatest(a, b), F.least(a, b)
    result = F.when(high <= 0, None)
    for tolerance in TOLERANCES:
        for value, kind in (((high - low) / high * 10, "saved"), (low / high * 10, "price")):
            fits = F.abs(value - discount) < tolerance
            result = result.when(fits, F.when(a >= b, F.lit(f"original,{kind}")).otherwise(F.lit(f"{kind},original")))
    return result


def is_product_image(size: Column, width: Column, height: Column, kind: Column) -> Column:
    """Large files are, small ones are not; between them, both sides and their ratio decide."""
    ratio = width / height
    between = (width > LEAST_SIDE) & (height > LEAST_SIDE) & (ratio > 0.5) & (ratio < 2) & kind.isNotNull()
    return F.when(size < SMALL_IMAGE, False).when(size > LARGE_IMAGE, True).otherwise(F.coalesce(between, F.lit(False)))
