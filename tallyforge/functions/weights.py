"""Weights that names carry, and how well two of them agree, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.text import folded

# What agreement of the weights adds to a match score.
SAME, NEAR, FAR, ONE_SIDED = 0.12, 0.05, -0.35, -0.04


def line_grams(name: Column) -> Column:
    """Grams of one portion: the least explicit weight under two kilos, else the first explicit one, else the least bare number from 20 to 500."""
    plain = F.regexp_replace(folded(name), r"[^a-z0-9\s]+", " ")
    pattern = r"\b([0-9]+)\s*(kgs?|grs?|g)\b"
    numbers, marks = F.regexp_extract_all(plain, F.lit(pattern), F.lit(1)), F.regexp_extract_all(plain, F.lit(pattern), F.lit(2))
    grams = F.zip_with(numbers, marks, lambda n, u: n.cast("double") * F.when(F.startswith(u, F.lit("kg")), 1000).otherwise(1))
    grams = F.filter(grams, lambda g: g > 0)
    portions = F.filter(grams, lambda g: g < 2000)
    bare = F.transform(F.regexp_extract_all(plain, F.lit(r"\b([0-9]{2,3})\b"), F.lit(1)), lambda n: n.cast("double"))
    bare = F.filter(bare, lambda n: n.between(20, 500))
    return F.coalesce(F.array_min(portions), F.get(grams, F.lit(0)), F.array_min(bare))


def weight_score(a: Column, b: Column) -> Column:
    """What the weights a and b, in grams, add to a match score."""
    gap, most = F.abs(a - b), F.greatest(a, b)
    near = (gap <= 15) | (gap / most <= 0.15)
    far = F.when(most < 500, (gap > 80) | (gap / most > 0.35)).otherwise((gap > 180) | (gap / most > 0.47))
    return (
        F.when(a.isNull() & b.isNull(), 0.0).when(a.isNull() | b.isNull(), ONE_SIDED)
        .when(a == b, SAME).when(near, NEAR).when(far, FAR).otherwise(0.0)
    )
