"""Column parsers for scraped fields: dates, counts, ids, coordinates, card lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sofralytics.functions import fixed_values as fv
from sofralytics.functions.numeric import clamp
from sofralytics.functions.text import contains_any, strip

_ISO_LAYOUTS = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss",
)
_DAY_LAYOUTS = ("yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy")


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, NULL when nothing matches."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def parse_timestamp(text: Column) -> Column:
    """ISO-8601 (``Z`` accepted), then day-first and year-first dates read as UTC; else NULL."""
    attempts = [F.try_to_timestamp(text, F.lit(layout)) for layout in _ISO_LAYOUTS + _DAY_LAYOUTS]
    return F.coalesce(*attempts)


def scraped_timestamp(text: Column, run_ts: Column) -> Column:
    """ISO timestamp of the scrape, or the run's own timestamp when missing or unreadable."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(layout)) for layout in _ISO_LAYOUTS + ("yyyy-MM-dd",)], run_ts)


def clean_rating(rating: Column) -> Column:
    """Whole stars limited to 1-5; text that is not a whole number becomes NULL."""
    as_text = strip(rating.cast("string"))
    whole = F.when(as_text.rlike(r"^[+-]?[0-9]+$"), as_text.try_cast("bigint"))
    return clamp(whole, 1, 5).cast("int")


def clean_phone(phone: Column) -> Column:
    return F.regexp_replace(phone, "[^0-9+]", "")


def relative_seconds(text: Column) -> Column:
    """Seconds meant by phrases such as "2 ay önce" or "3 weeks ago"; first matching unit wins."""
    phrase = F.lower(strip(text))
    chosen = None
    for pattern, unit in fv.RELATIVE_DATE_PATTERNS:
        value = F.regexp_extract(phrase, pattern, 1).try_cast("bigint") * F.lit(unit)
        hit = phrase.rlike(pattern)
        chosen = F.when(hit, value) if chosen is None else chosen.when(hit, value)
    for pattern, unit in fv.RELATIVE_DATE_SINGLES:
        chosen = chosen.when(phrase.rlike(pattern), F.lit(unit))
    return chosen.cast("bigint")


def relative_timestamp(text: Column, scraped_at: Column) -> Column:
    """The moment a relative phrase points to, counted back from when the row was scraped."""
    seconds = relative_seconds(text)
    return F.timestamp_micros(F.unix_micros(scraped_at.cast("timestamp")) - seconds * 1_000_000)


def parse_count(text: Column) -> Column:
    """Count with thousands separators of either locale and a B/K (thousand) suffix; 0 when unreadable."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9.,BbKk]", "")
    suffix = kept.rlike("[BbKk]$")
    # Thousand suffix.  A lone dot is a decimal mark, several dots are separators up to the last one,
    # and a comma without any dot is a separator.
    body = F.replace(F.regexp_replace(kept, ".$", ""), F.lit(","), F.lit("."))
    dots = F.length(kept) - F.length(F.replace(kept, F.lit("."), F.lit("")))
    squeezed = (
        F.when(dots == 0, F.replace(body, F.lit("."), F.lit("")))
        .when((dots > 1) & ~F.contains(kept, F.lit(",")), F.regexp_replace(body, r"\.(?=.*\.)", ""))
        .otherwise(body)
    )
    thousands = F.when(squeezed.rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)$"), squeezed.try_cast("double") * 1000.0)

    has_dot, has_comma = F.contains(kept, F.lit(".")), F.contains(kept, F.lit(","))
    last_dot = F.length(kept) - F.instr(F.reverse(kept), ".")
    last_comma = F.length(kept) - F.instr(F.reverse(kept), ",")
    no_comma = F.replace(kept, F.lit(","), F.lit(""))
    no_dot = F.replace(kept, F.lit("."), F.lit(""))
    plain = (
        F.when(has_dot & has_comma & (last_dot > last_comma), no_comma)
        .when(has_dot & has_comma, F.replace(no_dot, F.lit(","), F.lit(".")))
        .when(has_dot & kept.rlike(r"\.[^.]{3}$"), no_dot)
        .when(has_dot, kept)
        .when(has_comma & kept.rlike(r",[^,]{3}$"), no_comma)
        .when(has_comma, F.replace(kept, F.lit(","), F.lit(".")))
        .otherwise(kept)
    )
    number = F.when(plain.rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)$"), plain.try_cast("double"))
    return F.coalesce(F.floor(F.when(suffix, thousands).otherwise(number)), F.lit(0)).cast("bigint")


def short_count(text: Column) -> Column:
    """``1.2K`` style or the first whole number; 0 when there is none."""
    thousand = r"([0-9.,]+)\s*[kK]"
    body = F.replace(F.regexp_extract(text, thousand, 1), F.lit(","), F.lit("."))
    scaled = F.when(
        text.rlike(thousand) & body.rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)$"),
        F.floor(body.try_cast("double") * 1000.0),
    )
    return F.coalesce(scaled, found(text, "([0-9]+)").try_cast("bigint"), F.lit(0)).cast("bigint")


def place_id(url: Column) -> Column:
    """Place id inside a map URL: data block, then ``cid``, then ``ftid``; NULL when absent."""
    return F.coalesce(
        found(url, "!1s(0x[0-9a-fA-F]+:0x[0-9a-fA-F]+)"),
        F.concat(F.lit("cid_"), found(url, "[?&]cid=([0-9]+)")),
        found(url, "ftid=(0x[0-9a-fA-F]+:0x[0-9a-fA-F]+)"),
    )


def place_id_from_path(url: Column) -> Column:
    """Fallback id from the decoded path segment; NULL when fewer than four usable characters remain."""
    raw = F.replace(F.regexp_extract(url, "/maps/place/([^/]+)", 1), F.lit("+"), F.lit("%2B"))
    decoded = F.coalesce(F.try_url_decode(raw), raw)
    kept = F.regexp_replace(decoded, r"[^a-zA-Z0-9À-ɏЀ-ӿ؀-ۿ_-]", "_")
    kept = F.regexp_replace(F.regexp_replace(kept, "_+", "_"), "^_+|_+$", "")
    return F.when(F.length(kept) > 3, F.concat(F.lit("url_"), F.substring(kept, 1, 80)))


def coordinates(url: Column) -> Column:
    """Latitude and longitude in a map URL, kept only near the city; struct of NULLs otherwise."""
    number = r"(-?[0-9]+\.?[0-9]*)"
    pair = F.struct(
        found(url, "@" + number + "," + number, 1).try_cast("double").alias("lat"),
        found(url, "@" + number + "," + number, 2).try_cast("double").alias("lng"),
    )
    data = F.struct(
        found(url, "!3d" + number).try_cast("double").alias("lat"),
        found(url, "!4d" + number).try_cast("double").alias("lng"),
    )
    near = lambda p: (p["lat"] > 39.0) & (p["lat"] < 43.0) & (p["lng"] > 26.0) & (p["lng"] < 31.0)
    nothing = F.struct(F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"))
    return F.when(near(pair), pair).when(near(data), data).otherwise(nothing)


def point(lat: Column, lng: Column) -> Column:
    """Point struct when both parts are numbers, else NULL."""
    y, x = lat.try_cast("double"), lng.try_cast("double")
    return F.when(y.isNotNull() & x.isNotNull(), F.struct(y.alias("lat"), x.alias("lng")))


def card_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda s: strip(s)), lambda s: s != "")


def _first_hit(lines: Column, pattern: str) -> Column:
    hits = F.filter(lines, lambda s: s.rlike(pattern))
    return F.regexp_extract(F.try_element_at(hits, F.lit(1)), pattern, 1)


def card_rating(lines: Column) -> Column:
    """First "4,5"-like number on the card."""
    return F.replace(_first_hit(lines, r"([0-9][,.][0-9])\s*"), F.lit(","), F.lit(".")).try_cast("double")


def card_review_count(lines: Column) -> Column:
    """First number in parentheses on the card; 0 when absent."""
    return parse_count(_first_hit(lines, r"\(([0-9][0-9.,]*)\)"))


def card_categories(lines: Column, name: Column) -> Column:
    """Parts of the first line that names a kind of kitchen, without pure price signs."""
    hits = F.filter(lines, lambda s: contains_any(F.lower(s), fv.CATEGORY_KEYWORDS) & (s != name))
    parts = F.transform(F.split(F.try_element_at(hits, F.lit(1)), "[·•|]"), lambda s: strip(s))
    kept = F.filter(parts, lambda s: (s != "") & ~s.rlike("^[₺$€]+$"))
    return F.coalesce(kept, F.array().cast("array<string>"))


def card_price_tier(lines: Column) -> Column:
    """Length of the first run of price signs (lira before dollar or euro), at most 4; NULL without one."""
    lira = F.length(_first_hit(lines, "(₺{1,4})"))
    other = F.length(_first_hit(lines, r"(\${1,4}|€{1,4})"))
    return F.coalesce(F.when(lira > 0, lira), F.when(other > 0, other))


def card_address(lines: Column, name: Column) -> Column:
    """First line that names a district and is not the venue name; empty when there is none."""
    hits = F.filter(lines, lambda s: contains_any(F.lower(s), fv.ADDRESS_LINE_DISTRICTS) & (s != name))
    return F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit(""))


def real_image(url: Column) -> Column:
    """Image link, NULL for an inline ``data:`` picture."""
    return F.when(~F.contains(url, F.lit("data:")), url)


def stars(label: Column, filled: Column, width_style: Column) -> Column:
    """Stars of a review block: number in the label, else filled stars, else bar width."""
    number = F.replace(found(label, r"([0-9]+(?:[.,][0-9]+)?)"), F.lit(","), F.lit(".")).try_cast("double")
    whole = F.floor(number).cast("int")
    percent = found(width_style, r"width:\s*([0-9]+)%").try_cast("int")
    return F.coalesce(
        F.when(whole.between(1, 5), whole),
        F.when(filled > 0, clamp(filled, 1, 5).cast("int")),
        clamp(F.bround(percent / 20.0, 0).cast("int"), 1, 5).cast("int"),
    )


def text_hash(stripped: Column) -> Column:
    """The first 16 hex digits of the MD5 of a text that is trimmed already; an empty one has a hash as well."""
    return F.substring(F.md5(stripped.cast("binary")), 1, 16)


def review_id_or_hash(review_id: Column, block_text: Column) -> Column:
    """The given id, else the hash of the block's trimmed text; without either there is no id."""
    body = strip(block_text)
    return F.coalesce(F.when(review_id != "", review_id), F.when(F.length(body) > 0, text_hash(body)))


def captcha_page(html: Column, phrases=fv.REVIEW_PAGE_CAPTCHA_PHRASES) -> Column:
    return contains_any(F.lower(html), phrases)


def banned_response(status: Column, content_type: Column, html: Column) -> Column:
    """Ban by status code, or by a phrase in the first characters of an HTML body."""
    head = F.lower(F.substring(html, 1, fv.BAN_SCAN_CHARS))
    by_text = F.contains(content_type, F.lit("text/html")) & contains_any(head, fv.BAN_PHRASES)
    return status.isin(*fv.BAN_STATUS_CODES) | F.coalesce(by_text, F.lit(False))


def empty_page(html: Column) -> Column:
    return F.coalesce(F.length(strip(html)) < fv.EMPTY_PAGE_CHARS, F.lit(True))


def district_from_text(address: Column) -> Column:
    """District of the first known spelling in the address; empty when none occurs."""
    lowered = F.lower(address)
    chosen = None
    for spelling, district in fv.DISTRICT_SPELLINGS:
        hit = F.contains(lowered, F.lit(spelling))
        chosen = F.when(hit, F.lit(district)) if chosen is None else chosen.when(hit, F.lit(district))
    return F.coalesce(chosen, F.lit(""))

