"""Quality of predictions over labelled tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sofralytics.functions.numeric import round_to


def set_errors(rows: DataFrame, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """Per row: true positives, false positives and the expected items that were missed."""
    want, got = F.array_distinct(expected), F.array_distinct(predicted)
    hit = F.array_intersect(want, got)
    return rows.withColumns(
        {
            "true_positives": F.size(hit).cast("long"),
            "false_positives": (F.size(got) - F.size(hit)).cast("long"),
            "missed": F.array_sort(F.array_except(want, got)),
        }
    )


def precision_recall(errors: DataFrame) -> DataFrame:
    """Micro precision, recall and F1 over all rows; 0 where nothing was predicted or expected."""
    sums = errors.agg(
        F.sum("true_positives").alias("tp"), F.sum("false_positives").alias("fp"), F.sum(F.size("missed")).alias("fn")
    )
    ratio = lambda a, b: F.coalesce(a / F.when(b > 0, b), F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.select(
        "tp", "fp", "fn", round_to(p, 4).alias("precision"), round_to(r, 4).alias("recall"),
        round_to(ratio(2 * p * r, p + r), 4).alias("f1"),
    )


def absolute_error(rows: DataFrame, value: str, expected: str) -> DataFrame:
    """One row: rows compared and mean absolute error."""
    return rows.agg(F.count("*").alias("n"), round_to(F.avg(F.abs(F.col(value) - F.col(expected))), 4).alias("mae"))


def large_errors(rows: DataFrame, value: str, expected: str, limit: float = 0.3) -> DataFrame:
    error = F.abs(F.col(value) - F.col(expected))
    return rows.withColumn("error", round_to(error, 4)).filter(error > limit)
