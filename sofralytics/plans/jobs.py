"""User-level jobs: DataFrames in, DataFrames out; writing is left to the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from sofralytics.operators import dedup, dictionary, extract_html, scoring, sentiment, similar, validate
from sofralytics.session import ensure_checkpoint_dir


def clean(bronze_venues: DataFrame, bronze_reviews: DataFrame, run_ts: Column) -> dict[str, DataFrame]:
    """Valid, cleaned, first-seen venues and reviews, and the quarantined rows of both."""
    parts = validate.clean_feed(bronze_venues, bronze_reviews, run_ts)
    parts["venues"] = dedup.first_venues(parts["venues"])
    parts["reviews"] = dedup.first_reviews(parts["reviews"])
    return parts


def extract_pages(pages: DataFrame, scraped_at: Column, rules: extract_html.Rules = extract_html.Rules()) -> DataFrame:
    """Reviews parsed from raw pages that are neither blocked nor empty."""
    from pyspark.sql import functions as F

    from sofralytics.functions import parsing

    usable = pages.filter(~parsing.captcha_page(F.col("html")) & ~parsing.empty_page(F.col("html")))
    return extract_html.extract_reviews(usable, scraped_at, rules)


def extract_dishes(reviews: DataFrame, entries: DataFrame, fuzzy: bool = False) -> DataFrame:
    """Dishes of every review with category, region and item class."""
    lookup = dictionary.lookup_table(entries)
    found = (similar.fuzzy_mentions if fuzzy else dictionary.exact_mentions)(reviews, lookup)
    return dictionary.extracted_dishes(found, entries)


def process_reviews(reviews: DataFrame, entries: DataFrame, vectors: DataFrame, seeds: DataFrame, fuzzy: bool = False) -> dict[str, DataFrame]:
    """Mentions and dish scores of reviews (review_id, restaurant_id, text, star_rating).

    ``vectors``: review_id, embedding; ``seeds``: label, embedding.  One lineage from text to scores; shuffles
    happen on the review id and on (venue, dish) only.
    """
    ensure_checkpoint_dir(reviews.sparkSession)
    # Found dishes feed both the mentions and the aspects; keeping them saves splitting every text twice.
    dishes = extract_dishes(reviews, entries, fuzzy).checkpoint()
    labels = sentiment.review_sentiment(reviews, vectors, sentiment.prototypes(seeds))
    named = dishes.filter("is_food").selectExpr("review_id", "canonical AS food")
    mentions = sentiment.mention_rows(dishes, labels, sentiment.aspect_sentiment(sentiment.aspects(reviews, named)))
    return {"mentions": mentions, "sentiment": labels, "scores": scoring.score_dishes(sentiment.scoring_rows(mentions, reviews))}
