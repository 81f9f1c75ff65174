"""Sentiment from stars, keywords and embedding prototypes, at review and dish level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sofralytics.functions import fixed_values as fv
from sofralytics.functions.numeric import round_to
from sofralytics.functions.text import count_contained, sentences, strip

CLASS_ORDER = (1, 0, -1)


def label_name(label: Column) -> Column:
    return F.when(label == 1, "positive").when(label == 0, "neutral").when(label == -1, "negative")


def label_from_stars(stars: Column) -> Column:
    return F.when(stars >= 4, 1).when(stars <= 2, -1).when(stars.isNotNull(), 0)


def label_from_text(text: Column, positive=fv.POSITIVE_KEYWORDS, negative=fv.NEGATIVE_KEYWORDS) -> Column:
    """Sign of distinct positive minus distinct negative keywords contained in the text."""
    lowered = F.lower(strip(F.coalesce(text, F.lit(""))))
    return F.signum(count_contained(lowered, positive) - count_contained(lowered, negative)).cast("int")


def agreement(star_label: Column, text_label: Column) -> Column:
    """0.9 when both signals agree, 0.6 when one is neutral, 0.3 when they oppose."""
    return F.when(star_label == text_label, 0.9).when((star_label == 0) | (text_label == 0), 0.6).otherwise(0.3)


def weak_labels(reviews: DataFrame, **keywords) -> DataFrame:
    """review_id, star and text labels, the weak label (stars decide) and its confidence."""
    rows = reviews.select(
        "review_id",
        label_from_stars(F.col("star_rating")).alias("star_label"),
        label_from_text(F.col("text"), **keywords).alias("text_label"),
    )
    return rows.select(
        "review_id", "star_label", "text_label", F.col("star_label").alias("weak_label"),
        agreement(F.col("star_label"), F.col("text_label")).alias("weak_confidence"),
    )


def label_distribution(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("weak_label").agg(
        F.count("*").alias("n"), round_to(F.avg("weak_confidence"), 4).alias("mean_confidence")
    )


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def _unit(vector: Column) -> Column:
    norm = F.sqrt(_dot(vector, vector))
    return F.transform(vector, lambda x: x.cast("double") / F.when(norm > 0, norm).otherwise(F.lit(1.0)))


def prototypes(seeds: DataFrame) -> DataFrame:
    """One unit vector per class: mean of the class's unit vectors, normalised again.

    Averages run per (class, position) with map-side combine; only classes x dimensions values are
    ever regrouped into arrays.
    """
    flat = seeds.select("label", F.posexplode(_unit(F.col("embedding"))).alias("pos", "x"))
    means = flat.groupBy("label", "pos").agg(F.avg("x").alias("m"))
    whole = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("pairs"))
    return whole.select("label", _unit(F.transform("pairs", lambda p: p["m"])).alias("prototype"))


def _prototype_map(protos: DataFrame) -> Column:
    """The three prototypes as one literal map, evaluated once per query."""
    return protos.agg(F.map_from_entries(F.collect_list(F.struct("label", "prototype"))).alias("m")).scalar()


def nearest_prototype(vectors: DataFrame, protos: DataFrame) -> DataFrame:
    """Class by softmax over dot products with the prototypes; blank text is neutral at 0.5.

    ``vectors``: review_id, embedding and optionally text.  The prototypes reach every row as a scalar
    subquery, so there is no join.
    """
    rows = vectors.withColumn("_p", _prototype_map(protos)).withColumn("_u", _unit(F.col("embedding")))
    # An embedding that is all zeros keeps equal similarities.
    sims = [_dot(F.col("_u"), F.col("_p")[F.lit(label)]) for label in CLASS_ORDER]
    rows = rows.select(*vectors.columns, *[F.exp(s * fv.SOFTMAX_FACTOR).alias(f"_e{i}") for i, s in enumerate(sims)])
    total = F.col("_e0") + F.col("_e1") + F.col("_e2")
    probs = [F.col(f"_e{i}") / total for i in range(3)]
    rows = rows.select(*vectors.columns, *[p.alias(f"_q{i}") for i, p in enumerate(probs)])
    q = [F.col(f"_q{i}") for i in range(3)]
    best = (
        F.when((q[0] >= q[1]) & (q[0] >= q[2]), CLASS_ORDER[0])
        .when(q[1] >= q[2], CLASS_ORDER[1])
        .otherwise(CLASS_ORDER[2])
    )
    blank = (strip(F.coalesce("text", F.lit(""))) == "") if "text" in vectors.columns else F.lit(False)
    return rows.select(
        *vectors.columns,
        F.when(blank, 0).otherwise(best).alias("model_label"),
        F.when(blank, 0.5).otherwise(round_to(F.greatest(*q), 4)).alias("model_score"),
        F.when(blank, 0.33).otherwise(round_to(q[0], 4)).alias("p_positive"),
        F.when(blank, 0.34).otherwise(round_to(q[1], 4)).alias("p_neutral"),
        F.when(blank, 0.33).otherwise(round_to(q[2], 4)).alias("p_negative"),
    )


def ensemble(rows: DataFrame) -> DataFrame:
    """Final label and confidence from model_label, model_score, weak_label and weak_confidence."""
    m, w = F.col("model_score"), F.col("weak_confidence")
    agree = F.col("model_label") == F.col("weak_label")
    trust_model = (m > 0.75) & (w < 0.5)
    confidence = (
        F.when(agree, F.least(F.lit(0.95), (m + w) / 2 + 0.15)).when(trust_model, m * 0.7).otherwise(w * 0.6 + m * 0.2)
    )
    return rows.withColumns(
        {
            "final_label": F.when(agree | trust_model, F.col("model_label")).otherwise(F.col("weak_label")),
            "confidence": round_to(confidence, 4),
        }
    )


def review_sentiment(reviews: DataFrame, vectors: DataFrame, protos: DataFrame, **keywords) -> DataFrame:
    """Sentiment of every review: stars and keywords, plus the model class where a vector exists.

    A review without a vector keeps the weak label and its confidence.  A missing star counts as 3.
    """
    rated = reviews.withColumn("star_rating", F.coalesce("star_rating", F.lit(3)))
    weak = weak_labels(rated, **keywords)
    model = nearest_prototype(vectors.select("review_id", "embedding"), protos).select("review_id", "model_label", "model_score")
    both = ensemble(weak.join(model, "review_id", "left"))
    known = F.col("model_label").isNotNull()
    return both.select(
        "review_id",
        label_name(F.col("model_label")).alias("model_sentiment"),
        "model_score",
        label_name(F.col("weak_label")).alias("weak_sentiment"),
        label_name(F.when(known, F.col("final_label")).otherwise(F.col("weak_label"))).alias("final_sentiment"),
        F.when(known, F.col("confidence")).otherwise(F.col("weak_confidence")).alias("confidence"),
    )


def aspects(reviews: DataFrame, foods: DataFrame) -> DataFrame:
    """(review_id, food, sentence): the first sentence naming the dish, the whole text when the name
    spans sentences, no row when the text does not contain it."""
    rows = foods.select("review_id", "food").join(reviews.select("review_id", "text"), "review_id")
    needle = F.lower("food")
    hits = F.filter(sentences(F.col("text")), lambda s: F.contains(F.lower(s), needle))
    return rows.filter(F.contains(F.lower("text"), needle)).select(
        "review_id", "food", F.coalesce(F.try_element_at(hits, F.lit(1)), F.col("text")).alias("sentence")
    )


def aspect_sentiment(found: DataFrame, vectors: DataFrame | None = None, protos: DataFrame | None = None, **keywords) -> DataFrame:
    """Sentiment of each (review, dish) sentence.

    With sentence vectors (review_id, food, embedding) the nearest prototype decides; without them the
    keyword sign of the sentence does.
    """
    if vectors is not None:
        scored = nearest_prototype(found.join(vectors, ["review_id", "food"]).withColumnRenamed("sentence", "text"), protos)
        return scored.select("review_id", "food", label_name(F.col("model_label")).alias("aspect_sentiment"), F.col("model_score").alias("aspect_score"))
    label = label_from_text(F.col("sentence"), **keywords)
    return found.select("review_id", "food", label_name(label).alias("aspect_sentiment"), F.lit(0.5).alias("aspect_score"))


def mention_rows(extracted: DataFrame, sentiment: DataFrame, aspect: DataFrame) -> DataFrame:
    """Mention facts: the dish's own sentiment where known, else the review's; confidence from the match."""
    return (
        extracted.join(sentiment.select("review_id", "final_sentiment", F.col("confidence").alias("review_confidence")), "review_id")
        .join(aspect.withColumnRenamed("food", "canonical"), ["review_id", "canonical"], "left")
        .select(
            "review_id",
            F.col("matched_text").alias("food_name"),
            F.col("canonical").alias("canonical_name"),
            "category",
            round_to(F.col("score") / 100.0, 3).alias("confidence"),
            F.coalesce("aspect_sentiment", "final_sentiment").alias("sentiment"),
            F.coalesce("aspect_score", "review_confidence").alias("sentiment_score"),
            "is_food",
            "review_confidence",
        )
    )


def scoring_rows(mentions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Input of dish scoring: dishes only, weighted by the review's confidence, missing stars as 3."""
    return (
        mentions.filter("is_food")
        .join(reviews.select("review_id", "restaurant_id", "star_rating"), "review_id")
        .select(
            "review_id", "restaurant_id", F.col("canonical_name").alias("food"), "sentiment",
            F.col("review_confidence").alias("confidence"), F.coalesce("star_rating", F.lit(3)).alias("star_rating"),
        )
    )
