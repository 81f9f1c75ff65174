"""Precision, recall and error of predictions over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from sofralytics.functions import text
from sofralytics.operators import evaluate
from sofralytics.plans.registry import query, rounded
from sofralytics.plans.text_queries import TOKENS

_SETS = f"""sets AS (SELECT doc_id, list_distinct(list_filter(w, lambda x: length(x) >= 4)) AS want,
    list_distinct(list_filter(w, lambda x: length(x) <= 6)) AS got FROM (SELECT doc_id, {TOKENS} AS w FROM documents)),
    errs AS (SELECT doc_id, len(list_intersect(want, got)) AS tp, len(got) - len(list_intersect(want, got)) AS fp, len(want) - len(list_intersect(want, got)) AS fn FROM sets)"""


def _errors(t):
    words = text.tokens(F.col("text"))
    rows = t.documents.select("doc_id", words.alias("w")).select(
        "doc_id", F.filter("w", lambda x: F.length(x) >= 4).alias("expected"), F.filter("w", lambda x: F.length(x) <= 6).alias("predicted")
    )
    return evaluate.set_errors(rows)


@query("set_errors_per_row", sql=f"WITH {_SETS} SELECT doc_id, tp AS true_positives, fp AS false_positives, fn AS missed_count FROM errs")
def set_errors_per_row(t):
    return _errors(t).select("doc_id", "true_positives", "false_positives", F.size("missed").cast("long").alias("missed_count"))


_P, _R = "coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0)", "coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0)"


@query(
    "precision_recall",
    sql=f"""WITH {_SETS} SELECT tp, fp, fn, {rounded(_P, 4)} AS precision, {rounded(_R, 4)} AS recall,
            {rounded(f'coalesce(2 * {_P} * {_R} / nullif({_P} + {_R}, 0), 0)', 4)} AS f1
            FROM (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM errs)""",
)
def precision_recall(t):
    return evaluate.precision_recall(_errors(t))


_SCORED = "(SELECT doc_id, quality::DOUBLE AS expected, CASE WHEN n_chars % 10 < 7 THEN quality * 0.8 + 0.1 ELSE 0.45 END::DOUBLE AS score FROM labels JOIN documents USING (doc_id))"


def _scored(t):
    quality = F.col("quality").cast("double")
    score = F.when(F.col("n_chars") % 10 < 7, quality * 0.8 + 0.1).otherwise(F.lit(0.45))
    return t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select("doc_id", quality.alias("expected"), score.alias("score"))


@query("mean_absolute_error", sql=f"SELECT count(*) AS n, {rounded('avg(abs(score - expected))', 4)} AS mae FROM {_SCORED}")
def mean_absolute_error(t):
    return evaluate.absolute_error(_scored(t), "score", "expected")


@query("large_score_errors", sql=f"SELECT doc_id, score, expected, {rounded('abs(score - expected)', 4)} AS error FROM {_SCORED} WHERE abs(score - expected) > 0.3")
def large_score_errors(t):
    return evaluate.large_errors(_scored(t), "score", "expected")
