"""Sentiment over documents with labels and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from sofralytics.functions.numeric import round_to
from sofralytics.operators import scoring
from sofralytics.operators import sentiment as sent
from sofralytics.plans.dictionary_queries import EXTRACTED, extracted
from sofralytics.plans.registry import query, rounded, strings, stripped
from sofralytics.session import written

# Words that do occur in the driver documents, used next to the built-in Turkish lists.
POSITIVE = ("the", "les", "und", "tion", "ment")
NEGATIVE = ("ing", "des", "der", "eau", "ich")
WORDS = {"positive": POSITIVE, "negative": NEGATIVE}


def _reviews(t):
    return t.reviews_v.select("review_id", "restaurant_id", "text", F.col("rating").alias("star_rating"))


def _text_label(column: str) -> str:
    low = f"lower(trim({column}))"
    hits = lambda words: f"len(list_filter({strings(words)}, lambda k: contains({low}, k)))"
    return f"CAST(sign({hits(POSITIVE)} - {hits(NEGATIVE)}) AS INT)"


_STAR_LABEL = "CASE WHEN s >= 4 THEN 1 WHEN s <= 2 THEN -1 WHEN s IS NOT NULL THEN 0 END"
_AGREE = "CASE WHEN star_label = text_label THEN 0.9 WHEN star_label = 0 OR text_label = 0 THEN 0.6 ELSE 0.3 END::DOUBLE"
WEAK = f"""weak AS (SELECT *, {_AGREE} AS weak_confidence FROM (SELECT review_id, {_STAR_LABEL} AS star_label, {_text_label('text')} AS text_label
    FROM (SELECT review_id, text, coalesce(rating, 3) AS s FROM reviews_v)))"""


def _filled(t):
    return _reviews(t).withColumn("star_rating", F.coalesce("star_rating", F.lit(3)))


@query(
    "star_labels",
    "reviews_v",
    sql=f"SELECT review_id, {_STAR_LABEL} AS star_label FROM (SELECT review_id, rating AS s FROM reviews_v)",
)
def star_labels(t):
    return _reviews(t).select("review_id", sent.label_from_stars(F.col("star_rating")).alias("star_label"))


@query("text_labels", "reviews_v", sql=f"SELECT review_id, {_text_label('text')} AS text_label FROM reviews_v")
def text_labels(t):
    return _reviews(t).select("review_id", sent.label_from_text(F.col("text"), **WORDS).alias("text_label"))


@query("weak_labels", "reviews_v", sql=f", {WEAK} SELECT review_id, star_label, text_label, star_label AS weak_label, weak_confidence FROM weak")
def weak_labels(t):
    return sent.weak_labels(_filled(t), **WORDS)


@query(
    "weak_label_distribution",
    "reviews_v",
    sql=f", {WEAK} SELECT star_label AS weak_label, count(*) AS n, {rounded('avg(weak_confidence)', 4)} AS mean_confidence FROM weak GROUP BY 1",
)
def weak_label_distribution(t):
    return sent.label_distribution(sent.weak_labels(_filled(t), **WORDS))


_UNIT = "list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))))"
PROTOS = f"""units AS (SELECT review_id, label, {_UNIT} AS u FROM vectors_v),
    means AS (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(u) AS x, generate_subscripts(u, 1) AS pos FROM units) GROUP BY label, pos),
    sums AS (SELECT label, array_agg(m ORDER BY pos) AS v FROM means GROUP BY label),
    protos AS (SELECT label, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS p FROM sums)"""
MODEL = f"""{PROTOS},
    sims AS (SELECT review_id, exp(5.0 * max(CASE WHEN protos.label = 1 THEN list_inner_product(u, p) END)) AS e0,
        exp(5.0 * max(CASE WHEN protos.label = 0 THEN list_inner_product(u, p) END)) AS e1,
        exp(5.0 * max(CASE WHEN protos.label = -1 THEN list_inner_product(u, p) END)) AS e2 FROM units, protos GROUP BY review_id),
    model AS (SELECT review_id, CASE WHEN e0 >= e1 AND e0 >= e2 THEN 1 WHEN e1 >= e2 THEN 0 ELSE -1 END AS model_label,
        {rounded('greatest(e0, e1, e2) / (e0 + e1 + e2)', 4)} AS model_score, {rounded('e0 / (e0 + e1 + e2)', 4)} AS p_positive,
        {rounded('e1 / (e0 + e1 + e2)', 4)} AS p_neutral, {rounded('e2 / (e0 + e1 + e2)', 4)} AS p_negative FROM sims)"""


@query("class_prototypes", "vectors_v", sql=f", {PROTOS} SELECT label, pos, {rounded('p[pos]', 6)} AS value FROM (SELECT CAST(label AS INT) AS label, p, unnest(range(1, len(p) + 1)) AS pos FROM protos)")
def class_prototypes(t):
    rows = sent.prototypes(t.vectors_v).select("label", F.posexplode("prototype").alias("pos", "value"))
    return rows.select(F.col("label").cast("int").alias("label"), (F.col("pos") + 1).cast("long").alias("pos"), round_to(F.col("value"), 6).alias("value"))


@query("prototype_sentiment", "vectors_v", sql=f", {MODEL} SELECT review_id, model_label, model_score, p_positive, p_neutral, p_negative FROM model")
def prototype_sentiment(t):
    out = sent.nearest_prototype(t.vectors_v.select("review_id", "embedding"), sent.prototypes(t.vectors_v))
    return out.select("review_id", "model_label", "model_score", "p_positive", "p_neutral", "p_negative")


_NAME = lambda c: f"CASE {c} WHEN 1 THEN 'positive' WHEN 0 THEN 'neutral' WHEN -1 THEN 'negative' END"
SENTIMENT = f"""{WEAK}, {MODEL},
    ens AS (SELECT w.review_id, model_label, model_score, star_label, weak_confidence, model_label = star_label AS agree,
        model_score > 0.75 AND weak_confidence < 0.5 AS trust FROM weak w LEFT JOIN model m USING (review_id)),
    sentiment AS (SELECT review_id, {_NAME('model_label')} AS model_sentiment, model_score, {_NAME('star_label')} AS weak_sentiment,
        CASE WHEN model_label IS NULL THEN {_NAME('star_label')} WHEN agree OR trust THEN {_NAME('model_label')} ELSE {_NAME('star_label')} END AS final_sentiment,
        CASE WHEN model_label IS NULL THEN weak_confidence ELSE {rounded('''CASE WHEN agree THEN least(0.95, (model_score + weak_confidence) / 2 + 0.15)
            WHEN trust THEN model_score * 0.7 ELSE weak_confidence * 0.6 + model_score * 0.2 END''', 4)} END AS confidence FROM ens)"""


def _sentiment(t):
    return sent.review_sentiment(_reviews(t), t.vectors_v, sent.prototypes(t.vectors_v), **WORDS)


@query("review_sentiment", "reviews_v", "vectors_v", sql=f", {SENTIMENT} SELECT * FROM sentiment")
def review_sentiment(t):
    return _sentiment(t)


@query(
    "review_sentiment_distribution",
    "reviews_v",
    "vectors_v",
    sql=f", {SENTIMENT} SELECT final_sentiment, count(*) AS n, {rounded('avg(confidence)', 4)} AS mean_confidence FROM sentiment GROUP BY 1",
)
def review_sentiment_distribution(t):
    return _sentiment(t).groupBy("final_sentiment").agg(F.count("*").alias("n"), round_to(F.avg("confidence"), 4).alias("mean_confidence"))


ASPECTS = f"""{EXTRACTED},
    aspects AS (SELECT review_id, canonical AS food, coalesce(list_filter(list_transform(string_split_regex(text, '[.!?;]+'), lambda x: {stripped('x')}),
        lambda x: x <> '' AND contains(lower(x), lower(canonical)))[1], text) AS sentence
      FROM extracted JOIN documents ON review_id = doc_id WHERE is_food AND contains(lower(text), lower(canonical)))"""


def _aspects(t, dishes=None):
    found = (extracted(t) if dishes is None else dishes).filter("is_food").select("review_id", F.col("canonical").alias("food"))
    return sent.aspects(_reviews(t), found)


@query("aspect_sentences", "dictionary_v", sql=f", {ASPECTS} SELECT review_id, food, md5(sentence) AS sentence_md5 FROM aspects")
def aspect_sentences(t):
    return _aspects(t).select("review_id", "food", F.md5("sentence").alias("sentence_md5"))


@query("aspect_sentiment", "dictionary_v", sql=f", {ASPECTS} SELECT review_id, food, {_NAME(_text_label('sentence'))} AS aspect_sentiment FROM aspects")
def aspect_sentiment(t):
    return sent.aspect_sentiment(_aspects(t), **WORDS).select("review_id", "food", "aspect_sentiment")


MENTIONS = f"""{SENTIMENT}, {ASPECTS},
    mentions AS (SELECT e.review_id, e.matched_text AS food_name, e.canonical AS canonical_name, e.category, {rounded('e.score / 100.0', 3)} AS confidence,
        coalesce(a.aspect_sentiment, s.final_sentiment) AS sentiment, coalesce(a.aspect_score, s.confidence) AS sentiment_score, e.is_food, s.confidence AS review_confidence
      FROM extracted e JOIN sentiment s USING (review_id)
      LEFT JOIN (SELECT review_id, food, {_NAME(_text_label('sentence'))} AS aspect_sentiment, 0.5::DOUBLE AS aspect_score FROM aspects) a
        ON a.review_id = e.review_id AND a.food = e.canonical)"""


def _mentions(t):
    dishes = written(extracted(t), "dishes")
    return sent.mention_rows(dishes, _sentiment(t), sent.aspect_sentiment(_aspects(t, dishes), **WORDS))


@query("mention_rows", "reviews_v", "vectors_v", "dictionary_v", sql=f", {MENTIONS} SELECT * FROM mentions")
def mention_rows(t):
    return _mentions(t)


@query(
    "scoring_rows",
    "reviews_v",
    "vectors_v",
    "dictionary_v",
    sql=f""", {MENTIONS} SELECT review_id, restaurant_id, canonical_name AS food, sentiment, review_confidence AS confidence,
            CAST(coalesce(rating, 3) AS INT) AS star_rating FROM mentions JOIN reviews_v USING (review_id) WHERE is_food""",
)
def scoring_rows(t):
    rows = sent.scoring_rows(_mentions(t), _reviews(t))
    return rows.withColumn("star_rating", F.col("star_rating").cast("int"))


@query("review_text_scores", "reviews_v", "vectors_v", "dictionary_v")
def review_text_scores(t):
    """Dish scores from raw text: extraction, sentiment and scoring in one plan."""
    return scoring.score_dishes(sent.scoring_rows(_mentions(t), _reviews(t)))
