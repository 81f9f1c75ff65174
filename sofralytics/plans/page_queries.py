"""Review blocks of the raw pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from sofralytics.operators.extract_html import Rules, extract_reviews
from sofralytics.plans.registry import query

# The driver pages keep their text in <article>; its paragraphs stand for the review text.
ARTICLES = Rules(block=("article",), text=("p",), author=("h1",), date=("footer",))


@query("page_reviews")
def page_reviews(t):
    """Every article of every page as a parsed review block."""
    return extract_reviews(t.pages, F.lit("2024-06-01 00:00:00").cast("timestamp"), ARTICLES)


@query("page_review_texts")
def page_review_texts(t):
    """Pages without any known text element: the longer strings of the block are joined."""
    rules = Rules(block=("article",), text=("span.absent",))
    return extract_reviews(t.pages, F.lit("2024-06-01 00:00:00").cast("timestamp"), rules).select("page_id", "review_id", "text", "language")
