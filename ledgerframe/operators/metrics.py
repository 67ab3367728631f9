"""Binary classification metrics from counts, so that slices and replicates are one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerframe.functions.scores import ratio

METRICS = ("accuracy", "balanced_accuracy", "precision_macro", "recall_macro", "f1_macro", "mcc", "recall_positive", "recall_negative")


def counts(label: str = "label", predicted: str = "predicted", weight: Column | None = None) -> list[Column]:
    """Aggregates tp, fn, tn, fp over 0/1 columns."""
    one = F.lit(1) if weight is None else weight
    cell = lambda a, b, name: F.coalesce(F.sum(F.when((F.col(label) == a) & (F.col(predicted) == b), one)), F.lit(0)).cast("long").alias(name)
    return [cell(1, 1, "tp"), cell(1, 0, "fn"), cell(0, 0, "tn"), cell(0, 1, "fp")]


def from_counts(tp: Column, fn: Column, tn: Column, fp: Column) -> dict[str, Column]:
    """All METRICS; labels are fixed to 0 and 1 and a zero denominator gives 0."""
    recall = ratio(tp, tp + fn), ratio(tn, tn + fp)
    precision = ratio(tp, tp + fp), ratio(tn, tn + fn)
    f1 = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fn + fp)
    half = lambda pair: (pair[0] + pair[1]) / F.lit(2.0)
    d = lambda c: c.cast("double")
    spread = F.sqrt(d(tp + fp) * d(tp + fn) * d(tn + fp) * d(tn + fn))
    mcc = ratio(d(tp) * d(tn) - d(fp) * d(fn), spread)
    return dict(zip(METRICS, (ratio(tp + tn, tp + tn + fp + fn), half(recall), half(precision), half(recall), half(f1), mcc, recall[0], recall[1]), strict=True))


def with_metrics(df: DataFrame, digits: int | None = 12) -> DataFrame:
    """df, which has tp, fn, tn and fp, with all METRICS."""
    made = from_counts(*(F.col(c) for c in ("tp", "fn", "tn", "fp")))
    return df.withColumns({k: F.round(v, digits) if digits else v for k, v in made.items()})


def evaluate(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Per slice: the four counts and all METRICS."""
    return with_metrics(predictions.groupBy(*by).agg(*counts()))


def confusion(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Per slice a row for each of the four cells, empty ones too."""
    wide = predictions.groupBy(*by).agg(*counts())
    cells = F.array(*(F.struct(F.lit(a).alias("label"), F.lit(b).alias("predicted"), F.col(c).alias("n")) for a, b, c in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))))
    return wide.select(*by, F.inline(cells))


def per_class(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Per slice and class: precision, recall, f1 and support."""
    wide = predictions.groupBy(*by).agg(*counts())
    tp, fn, tn, fp = (F.col(c) for c in ("tp", "fn", "tn", "fp"))
    row = lambda k, t, miss, wrong: F.struct(F.lit(k).alias("class"), F.round(ratio(t, t + wrong), 12).alias("precision"), F.round(ratio(t, t + miss), 12).alias("recall"), F.round(ratio(2 * t, 2 * t + wrong + miss), 12).alias("f1"), (t + miss).alias("support"))
    return wide.select(*by, F.inline(F.array(row(0, tn, fp, fn), row(1, tp, fn, fp))))


def roc_auc(df: DataFrame, label: str, value: str, by: list[str]) -> DataFrame:
    """Per slice the area under the ROC curve of value, and separation, the better of it and its reverse; null where one label is missing.

    Equal values are counted first; over the distinct values, a running count of negatives gives the
    pairs that are in order, ties as halves. No window holds single rows.
    """
    at = df.groupBy(*by, F.col(value).alias("v")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = at.withColumn("won", F.col("p") * (below + F.col("q") / F.lit(2.0)))
    auc = F.sum("won") / F.nullif(F.sum("p") * F.sum("q"), F.lit(0))
    return won.groupBy(*by).agg(F.round(auc, 12).alias("auc"), F.round(F.greatest(auc, 1 - auc), 12).alias("separation"))


def cohen_d(df: DataFrame, label: str, value: str, by: list[str]) -> DataFrame:
    """Per slice the standardised difference of class means, 0 where the pooled deviation is 0."""
    v = lambda k: F.when(F.col(label) == k, F.col(value).cast("double"))
    agg = df.groupBy(*by).agg(*(f(v(k)).alias(f"{n}{k}") for k in (0, 1) for n, f in (("m", F.avg), ("s", F.var_samp), ("n", F.count))))
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("s1") + (F.col("n0") - 1) * F.col("s0")) / F.nullif(F.col("n1") + F.col("n0") - 2, F.lit(0)))
    return agg.select(*by, F.round(ratio(F.col("m1") - F.col("m0"), pooled), 9).alias("cohen_d"))
