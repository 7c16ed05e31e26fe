"""Colour expressions on samples 0 to 255."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def grey(b: Column, g: Column, r: Column) -> Column:
    """Luma weights .114, .587 and .299."""
    return F.bround(b * F.lit(0.114) + g * F.lit(0.587) + r * F.lit(0.299), 0).cast("int")


def saturation(b: Column, g: Column, r: Column) -> Column:
    """Saturation of hue-saturation-value, 0 to 255; black has none."""
    top, low = F.greatest(b, g, r), F.least(b, g, r)
    return F.when(top == 0, 0).otherwise(F.bround(F.lit(255.0) * (top - low) / F.greatest(top, F.lit(1)), 0).cast("int"))
