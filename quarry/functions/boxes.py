"""Box geometry; a box is the columns x0, y0, x1, y1 with a prefix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _area(p: str) -> Column:
    return F.greatest(F.col(f"{p}x1") - F.col(f"{p}x0"), F.lit(0.0)) * F.greatest(F.col(f"{p}y1") - F.col(f"{p}y0"), F.lit(0.0))


def overlap(a: str, b: str) -> Column:
    w = F.least(f"{a}x1", f"{b}x1") - F.greatest(f"{a}x0", f"{b}x0")
    h = F.least(f"{a}y1", f"{b}y1") - F.greatest(f"{a}y0", f"{b}y0")
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: str, b: str) -> Column:
    union = _area(a) + _area(b) - overlap(a, b)
    return F.when(union > 0, overlap(a, b) / union).otherwise(0.0)


def coverage(inner: str, outer: str) -> Column:
    return F.when(_area(inner) > 0, overlap(inner, outer) / _area(inner)).otherwise(0.0)
