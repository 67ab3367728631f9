"""Column functions over predictions and measurements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def logistic(decision: Column, bound: float = 50.0) -> Column:
    clipped = F.greatest(F.lit(-bound), F.least(F.lit(bound), decision.cast("double")))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clipped))


def confidence(score: Column, predicted: Column) -> Column:
    return F.when(predicted == 1, score).otherwise(F.lit(1.0) - score)


def agrees(score: Column, predicted: Column, threshold: float = 0.5) -> Column:
    return (score >= threshold).cast("int") == predicted


def error_type(label: Column, predicted: Column, names: tuple[str, str, str] = ("correct", "false_negative", "false_positive")) -> Column:
    return F.when(label == predicted, names[0]).when(label == 1, names[1]).otherwise(names[2])


def right_closed(c: Column, bounds: list[float], names: list[str]) -> Column:
    """The name of the interval, closed on the right, that c is in; the last is open-ended."""
    out = None
    for b, n in zip(bounds, names, strict=False):
        out = F.when(c <= b, n) if out is None else out.when(c <= b, n)
    return out.when(c.isNotNull(), names[len(bounds)])


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def feature_text(c: Column) -> Column:
    return F.when(F.abs(c) >= 100, F.format_number(c, 1)).otherwise(F.format_string("%.4f", c))


def log_metadata(size: Column, width: Column, height: Column) -> list[Column]:
    return [F.log1p(size).alias("log_size"), F.log1p(width).alias("log_width"), F.log1p(height).alias("log_height"), F.log1p(width * height).alias("log_pixels"), (width / F.greatest(height, F.lit(1))).alias("aspect")]
