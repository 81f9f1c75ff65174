"""Turkish-aware text expressions.  All are built-in column expressions except NFKD."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from sofralytics.functions import fixed_values as fv

WORD = r"[\p{L}\p{N}_]+"
NON_WORD = r"[^\p{L}\p{N}_]+"
# Every character Python's str.strip and \\s treat as white space.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"


def strip(text: Column) -> Column:
    """Both ends freed of any Unicode white space, not just blanks."""
    return F.btrim(text, F.lit(WHITESPACE))


def turkish_lower(text: Column) -> Column:
    """Lower case with the Turkish dotted/dotless i rule applied first."""
    return F.lower(F.replace(F.replace(text, F.lit("İ"), F.lit("i")), F.lit("I"), F.lit("ı")))


def fold_letters(text: Column) -> Column:
    """Turkish letters to their ASCII look-alikes, case kept."""
    return F.translate(text, "çÇğĞıİöÖşŞüÜ", "cCgGiIoOsSuU")


def fold(text: Column) -> Column:
    """Case- and accent-insensitive form used as a join key."""
    return strip(F.lower(fold_letters(text)))


# Latin-1 and Latin Extended-A letters and the ASCII letters they are accented forms of.
ACCENTED = {c: b for c in map(chr, range(0xC0, 0x180)) if (b := unicodedata.normalize("NFD", c)[0]) != c and b.isascii()}
ACCENTED |= {"ı": "i", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D"}


def search_key(text: Column) -> Column:
    """Form in which queries and stored names meet: no accents of any Latin letter, lower case, stripped."""
    return strip(F.lower(F.translate(text, "".join(ACCENTED), "".join(ACCENTED.values()))))


def ascii_fold(text: Column) -> Column:
    """ASCII form of already lower-cased Turkish text."""
    return F.translate(text, "çğıöşü", "cgiosu")


def tokens(text: Column) -> Column:
    """Lower-cased word tokens; NULL gives an empty array."""
    words = F.array_remove(F.split(turkish_lower(text), NON_WORD), "")
    return F.coalesce(words, F.array().cast("array<string>"))


def without_stopwords(words: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in fv.TURKISH_STOPWORDS])
    return F.filter(words, lambda w: ~F.array_contains(stop, w))


def ngrams(words: Column, n: int) -> Column:
    """Space-joined runs of n tokens; empty array when there are fewer than n."""
    return F.when(
        F.size(words) >= n,
        F.transform(
            F.sequence(F.lit(1), F.size(words) - F.lit(n - 1)),
            lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "),
        ),
    ).otherwise(F.array().cast("array<string>"))


def normalize(text: Column) -> Column:
    """Lower-cased, punctuation and underscores to spaces, spaces collapsed, Turkish letters kept."""
    spaced = F.regexp_replace(turkish_lower(text), r"[^\p{L}\p{N}]+", " ")
    return F.trim(F.coalesce(spaced, F.lit("")))


def squeeze_lower(text: Column) -> Column:
    """Plain lower case, trimmed, inner white space collapsed."""
    return strip(F.regexp_replace(F.lower(text), SPACE_RUN, " "))


def clean_scraped(text: Column) -> Column:
    """Scraped text: white space collapsed, five entities decoded, invisible characters removed."""
    out = F.regexp_replace(text, SPACE_RUN, " ")
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.regexp_replace(out, r"[\u200B\uFEFF]", "")
    return strip(F.coalesce(out, F.lit("")))


def language_flag(text: Column, mode: str = "turkish") -> Column:
    """``tr`` or ``other``.  ``mode='compat'`` counts the plain ASCII letters of the original rule."""
    letters = fv.COMPAT_LETTERS if mode == "compat" else fv.TURKISH_LETTERS
    marked = F.length(text) - F.length(F.translate(text, letters, ""))
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))
    known = F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in fv.TURKISH_MARKER_WORDS])))
    total = F.greatest(F.size(words), F.lit(1))
    is_turkish = (
        (marked / F.greatest(F.length(text), F.lit(1)) > 0.02) | (known / total > 0.1) | (known >= 2)
    )
    short = text.isNull() | (F.length(strip(text)) < 3)
    return F.when(short | is_turkish, F.lit("tr")).otherwise(F.lit("other"))


@pandas_udf(StringType())
def nfkd_ascii(text: pd.Series) -> pd.Series:
    """NFKD decomposition with everything outside ASCII dropped; no built-in does this."""
    return text.map(
        lambda s: None if s is None else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode("ascii")
    )


def _dashed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slug(name: Column, district: Column, source_id: Column, nfkd: bool = True) -> Column:
    """URL slug of a venue: folded name (or the source id when nothing is left) plus the district.

    With ``nfkd`` accented letters outside the Turkish alphabet decompose to their base letter;
    names that are ASCII after folding never reach the Python step.
    """
    folded = F.translate(name, "çÇşŞğĞüÜöÖıIİ", "cCsSgGuUoOiIi") if nfkd else fold_letters(name)
    folded = F.coalesce(folded, F.lit(""))
    if nfkd:
        folded = F.when(folded.rlike(r"^[\x00-\x7F]*$"), folded).otherwise(nfkd_ascii(folded))
    base = _dashed(folded)
    base = F.when((base == "") & source_id.isNotNull(), _dashed(source_id)).otherwise(base)
    area = F.coalesce(_dashed(fold_letters(district)), F.lit(""))
    return F.when(area == "", base).when(base == "", area).otherwise(F.concat_ws("-", base, area))


def word_slug(text: Column) -> Column:
    """Slug that keeps ASCII word characters: other signs are removed, spaces and ``_`` become ``-``."""
    out = strip(F.lower(fold_letters(text)))
    out = F.regexp_replace(out, r"[^A-Za-z0-9_\s-]", "")
    out = F.regexp_replace(out, r"[\s_]+", "-")
    return F.regexp_replace(out, "^-+|-+$", "")


def is_slug(text: Column) -> Column:
    return text.rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$")


def sentences(text: Column) -> Column:
    """Trimmed, non-empty parts between sentence marks."""
    return F.filter(F.transform(F.split(text, "[.!?;]+"), strip), lambda s: s != "")


def trigrams(text: Column) -> Column:
    """Distinct padded character trigrams of every word, as the PostgreSQL trigram extension builds them."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    per_word = F.transform(
        words,
        lambda w: F.transform(
            F.sequence(F.lit(1), F.length(w) + 1),
            lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)),
        ),
    )
    return F.array_distinct(F.flatten(per_word))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared over distinct trigrams of two precomputed trigram arrays."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def count_contained(text: Column, phrases) -> Column:
    """How many of the phrases occur in the text; unrolled so it stays inside generated code."""
    total = F.lit(0)
    for phrase in phrases:
        total = total + F.contains(text, F.lit(phrase)).cast("int")
    return total


def contains_any(text: Column, phrases) -> Column:
    hit = F.lit(False)
    for phrase in phrases:
        hit = hit | F.contains(text, F.lit(phrase))
    return hit


def first_contained(text: Column, phrases) -> Column:
    """The first phrase (in the given order) that occurs in the text, else NULL."""
    chosen = None
    for phrase in phrases:
        hit = F.contains(text, F.lit(phrase))
        chosen = F.when(hit, F.lit(phrase)) if chosen is None else chosen.when(hit, F.lit(phrase))
    return chosen
