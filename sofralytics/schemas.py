"""Explicit schemas of the tables and of scraped records; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType, BooleanType, DateType, DecimalType, DoubleType, IntegerType, LongType, ShortType,
    StringType, StructField, StructType, TimestampType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


_TEXT, _WHEN, _LONG, _INT, _FLAG = StringType(), TimestampType(), LongType(), IntegerType(), BooleanType()
POINT = _struct(lat=DoubleType(), lng=DoubleType())
DISTRIBUTION = _struct(positive=_INT, neutral=_INT, negative=_INT)

TABLES: dict[str, StructType] = {
    "restaurants": _struct(
        id=_LONG, name=_TEXT, slug=_TEXT, address=_TEXT, district=_TEXT, neighborhood=_TEXT, location=POINT,
        phone=_TEXT, website=_TEXT, cuisine_type=ArrayType(_TEXT), price_range=ShortType(),
        overall_score=DecimalType(4, 2), total_reviews=_INT, is_active=_FLAG, image_url=_TEXT,
        created_at=_WHEN, updated_at=_WHEN,
    ),
    "restaurant_platforms": _struct(
        id=_LONG, restaurant_id=_LONG, platform=_TEXT, external_id=_TEXT, external_url=_TEXT,
        platform_score=DecimalType(4, 2), platform_reviews=_INT, match_confidence=DecimalType(4, 2),
        last_scraped=_WHEN, raw_data=_TEXT,
    ),
    "dishes": _struct(
        id=_LONG, name=_TEXT, slug=_TEXT, canonical_name=_TEXT, category=_TEXT, subcategory=_TEXT,
        is_main_dish=_FLAG, aliases=ArrayType(_TEXT), search_lexemes=ArrayType(_TEXT), created_at=_WHEN,
    ),
    "restaurant_dishes": _struct(
        id=_LONG, restaurant_id=_LONG, dish_id=_LONG, avg_sentiment=DecimalType(3, 2), positive_count=_INT,
        negative_count=_INT, neutral_count=_INT, total_mentions=_INT, computed_score=DecimalType(4, 2),
        price=DecimalType(8, 2), last_updated=_WHEN,
    ),
    "reviews": _struct(
        id=_LONG, restaurant_platform_id=_LONG, external_review_id=_TEXT, author_name=_TEXT, rating=ShortType(),
        text=_TEXT, review_date=_WHEN, language=_TEXT, scraped_at=_WHEN, processed=_FLAG,
    ),
    "review_dish_mentions": _struct(
        id=_LONG, review_id=_LONG, dish_id=_LONG, mention_text=_TEXT, sentiment=_TEXT,
        sentiment_score=DecimalType(4, 3), extraction_method=_TEXT, confidence=DecimalType(3, 2), created_at=_WHEN,
    ),
    "scrape_jobs": _struct(
        id=_LONG, platform=_TEXT, target_type=_TEXT, target_id=_TEXT, status=_TEXT, started_at=_WHEN,
        completed_at=_WHEN, items_scraped=_INT, error_message=_TEXT, metadata=_TEXT,
    ),
    "advertisements": _struct(
        id=_LONG, restaurant_id=_LONG, ad_type=_TEXT, title=_TEXT, content=_TEXT, image_url=_TEXT, target_url=_TEXT,
        start_date=DateType(), end_date=DateType(), is_active=_FLAG, impressions=_INT, clicks=_INT, created_at=_WHEN,
    ),
    "food_mentions": _struct(
        id=_LONG, review_id=_LONG, food_name=_TEXT, canonical_name=_TEXT, category=_TEXT,
        confidence=DecimalType(4, 3), sentiment=_TEXT, sentiment_score=DecimalType(4, 3), is_food=_FLAG, created_at=_WHEN,
    ),
    "food_scores": _struct(
        id=_LONG, restaurant_id=_LONG, food_name=_TEXT, score=DecimalType(4, 2), review_count=_INT,
        confidence=DecimalType(4, 3), sentiment_distribution=DISTRIBUTION, last_updated=_WHEN,
    ),
    "nlp_jobs": _struct(
        id=_LONG, started_at=_WHEN, completed_at=_WHEN, reviews_processed=_INT, food_mentions_created=_INT,
        food_scores_updated=_INT, status=_TEXT, error_log=_TEXT,
    ),
}

# Scraped records: every field optional, numbers that may be malformed kept as text.
BRONZE_VENUE = _struct(
    name=_TEXT, slug=_TEXT, address=_TEXT, district=_TEXT, neighborhood=_TEXT, city=_TEXT, latitude=_TEXT,
    longitude=_TEXT, phone=_TEXT, website=_TEXT, cuisine_types=ArrayType(_TEXT), price_range=_INT,
    rating=DoubleType(), total_reviews=_INT, image_url=_TEXT, source=_TEXT, source_id=_TEXT, source_url=_TEXT,
    raw_data=_TEXT, scraped_at=_TEXT, arrival=_LONG,
)
BRONZE_REVIEW = _struct(
    restaurant_source=_TEXT, restaurant_source_id=_TEXT, external_review_id=_TEXT, author_name=_TEXT, rating=_TEXT,
    text=_TEXT, review_date=_TEXT, language=_TEXT, raw_data=_TEXT, scraped_at=_TEXT, arrival=_LONG,
)
DISH_DICTIONARY = _struct(canonical=_TEXT, aliases=ArrayType(_TEXT), category=_TEXT, region=_TEXT)
JOB_LEDGER = _struct(
    job=_TEXT, started_at=_WHEN, completed_at=_WHEN, status=_TEXT, rows_read=_LONG, rows_written=_LONG,
    rows_rejected=_LONG, error_log=_TEXT,
)
