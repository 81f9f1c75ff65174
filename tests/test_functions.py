import datetime

import pytest
from pyspark.sql import functions as F

from sofralytics.functions import geo, parsing, text


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'double'}" for k, v in values.items()))
    return frame.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    "raw, want",
    [("1.234", 1234), ("1,234", 1234), ("1234", 1234), ("1.2B", 1200), ("2K", 2000), ("1.234,5", 1234), ("1,234.5", 1234), ("4.5", 4),
     ("4,5", 4), ("", 0), ("yok", 0), (None, 0), ("(87)", 87), ("1,2B", 12000), ("1.234.567", 1234567)],
)
def test_parse_count(spark, raw, want):
    assert one(spark, parsing.parse_count(F.col("x")), x=raw) == want


@pytest.mark.parametrize("raw, want", [("123", 123), ("1.2K", 1200), ("1,5 k", 1500), ("abc", 0), (None, 0), ("7 begeni", 7)])
def test_short_count(spark, raw, want):
    assert one(spark, parsing.short_count(F.col("x")), x=raw) == want


@pytest.mark.parametrize(
    "raw, seconds",
    [("2 ay önce", 2 * 2592000), ("1 hafta once", 604800), ("3 gün önce", 3 * 86400), ("a month ago", 2592000), ("5 years ago", 5 * 31536000),
     ("10 dk", 600), ("yesterday", None), (None, None)],
)
def test_relative_seconds(spark, raw, seconds):
    assert one(spark, parsing.relative_seconds(F.col("x")), x=raw) == seconds


@pytest.mark.parametrize(
    "raw, want",
    [("2024-03-05", datetime.datetime(2024, 3, 5)), ("05.03.2024", datetime.datetime(2024, 3, 5)), ("05/03/2024", datetime.datetime(2024, 3, 5)),
     ("2024-03-05T10:20:30Z", datetime.datetime(2024, 3, 5, 10, 20, 30)), ("2024-03-05T12:20:30+02:00", datetime.datetime(2024, 3, 5, 10, 20, 30)),
     ("dün", None), (None, None)],
)
def test_parse_timestamp(spark, raw, want):
    got = one(spark, F.date_format(parsing.parse_timestamp(F.col("x")), "yyyy-MM-dd HH:mm:ss"), x=raw)
    assert got == (want and want.strftime("%Y-%m-%d %H:%M:%S"))


@pytest.mark.parametrize("raw, want", [("5", 5), ("9", 5), ("-1", 1), ("abc", None), ("4.5", None), (" 3 ", 3), (None, None)])
def test_clean_rating(spark, raw, want):
    assert one(spark, parsing.clean_rating(F.col("x")), x=raw) == want


@pytest.mark.parametrize(
    "label, filled, style, want",
    [("5 üzerinden 4 yıldız", 0, "", 5), ("Rated 4.0 out of 5.0", 0, "", 4), ("", 3, "", 3), ("", 9, "", 5), ("", 0, "width: 50%", 2),
     ("", 0, "width:70%", 4), ("", 0, "", None), ("12 yorum", 2, "", 2)],
)
def test_stars(spark, label, filled, style, want):
    frame = spark.createDataFrame([(label, filled, style)], "l string, f int, s string")
    assert frame.select(parsing.stars(F.col("l"), F.col("f"), F.col("s")).alias("o")).first()["o"] == want


def test_place_ids(spark):
    url = "https://maps/maps/place/Kebap+Evi/data=!1s0x14ca:0xff!3d41.05!4d29.1"
    assert one(spark, parsing.place_id(F.col("x")), x=url) == "0x14ca:0xff"
    assert one(spark, parsing.place_id(F.col("x")), x="https://m/?q=1&cid=77") == "cid_77"
    assert one(spark, parsing.place_id(F.col("x")), x="https://m/none") is None
    assert one(spark, parsing.place_id_from_path(F.col("x")), x="https://m/maps/place/K%C3%B6fteci%20Ali/@1,2") == "url_Köfteci_Ali"
    assert one(spark, parsing.place_id_from_path(F.col("x")), x="https://m/maps/place/ab/") is None
    where = one(spark, parsing.coordinates(F.col("x")), x=url)
    assert (where["lat"], where["lng"]) == (41.05, 29.1)
    outside = one(spark, parsing.coordinates(F.col("x")), x="https://m/@10.0,20.0,15z")
    assert outside["lat"] is None


def test_card_fields(spark):
    card = "Deniz\n4,5 (1.234)\nTürk Restoranı · ₺₺ | Kebap\nModa, Kadikoy 3"
    lines = parsing.card_lines(F.col("x"))
    assert one(spark, parsing.card_rating(lines), x=card) == 4.5
    assert one(spark, parsing.card_review_count(lines), x=card) == 1234
    assert one(spark, parsing.card_categories(lines, F.lit("Deniz")), x=card) == ["Türk Restoranı", "Kebap"]
    assert one(spark, parsing.card_price_tier(lines), x=card) == 2
    assert one(spark, parsing.card_address(lines, F.lit("Deniz")), x=card) == "Moda, Kadikoy 3"
    assert one(spark, parsing.card_price_tier(lines), x="a\nb") is None


def test_text_rules(spark):
    assert one(spark, text.turkish_lower(F.col("x")), x="IŞIK İNCİ") == "ışık inci"
    assert one(spark, text.tokens(F.col("x")), x="Çay, ve_kahve! 2'li") == ["çay", "ve_kahve", "2", "li"]
    assert one(spark, text.tokens(F.col("x")), x=None) == []
    assert one(spark, text.normalize(F.col("x")), x="  Adana_Kebap!!  ACILI ") == "adana kebap acılı"
    assert one(spark, text.ngrams(text.tokens(F.col("x")), 2), x="a b c") == ["a b", "b c"]
    assert one(spark, text.ngrams(text.tokens(F.col("x")), 4), x="a b c") == []
    assert one(spark, text.clean_scraped(F.col("x")), x=" a \n b &amp; &lt;c&gt;​﻿ ") == "a b & <c>"
    assert one(spark, text.sentences(F.col("x")), x="İyi. Kötü!? ; son") == ["İyi", "Kötü", "son"]
    assert one(spark, text.language_flag(F.col("x")), x="yemek çok güzel") == "tr"
    assert one(spark, text.language_flag(F.col("x")), x="the food was fine") == "other"
    assert one(spark, text.language_flag(F.col("x"), "compat"), x="the food was so good") == "tr"
    assert one(spark, text.word_slug(F.col("x")), x=" Karadeniz Pidesi & Çay ") == "karadeniz-pidesi-cay"


def test_slug(spark):
    make = lambda nfkd: text.slug(F.col("x"), F.col("d"), F.col("i"), nfkd=nfkd)
    assert one(spark, make(True), x="İnci Köfte é", d="Kadıköy", i="7") == "inci-kofte-e-kadikoy"
    assert one(spark, make(False), x="İnci Köfte é", d="", i="7") == "inci-kofte"
    assert one(spark, make(True), x="東京", d=None, i="ID 9") == "id-9"


def test_trigram_similarity(spark):
    sim = text.trigram_similarity(text.trigrams(F.col("x")), text.trigrams(F.col("y")))
    assert one(spark, sim, x="word", y="word") == 1.0
    assert abs(one(spark, sim, x="word", y="two words") - 4 / 11) < 1e-9
    assert one(spark, sim, x="", y="") == 0.0


def test_geo(spark):
    km = geo.haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    assert abs(one(spark, km, a=41.0, b=29.0, c=42.0, d=29.0) - 111.19492664455873) < 1e-6
    assert one(spark, geo.nearest_district(F.col("a"), F.col("b")), a=40.98, b=29.06) == "kadikoy"
    assert one(spark, geo.district(F.col("x"), F.col("a"), F.col("b")), x="Beşiktaş, No 3", a=40.98, b=29.06) == "besiktas"
    assert one(spark, geo.district(F.col("x"), F.col("a"), F.col("b")), x="yok", a=40.98, b=29.06) == "kadikoy"
