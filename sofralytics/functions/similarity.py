"""String similarity ratios (0-100) as Arrow UDFs; Spark has no built-in for them.

``ratio`` is 200 x LCS / (len a + len b).  The weighted ratio is the usual combination of the full, token
and best-window ratios.  Only pairs that passed a blocking join reach these functions.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from sofralytics.functions.text import strip


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine-integer step per character of ``b``."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    state = full
    for ch in b:
        hit = state & where.get(ch, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * lcs_length(a, b) / total


def sorted_words(text: str) -> str:
    return " ".join(sorted(text.split()))


def window_ratio(a: str, b: str, floor: float = 0.0) -> float:
    """Best ratio of the shorter text with any stretch of the longer that is no longer than it.

    A value that cannot exceed ``floor`` may be returned as 0: with c characters in common (order aside) no
    stretch reaches more than 200 c / (m + c).
    """
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    m, n = len(short), len(long)
    if m == 0:
        return 100.0 if n == 0 else 0.0
    if short in long:
        return 100.0
    common = sum(min(short.count(ch), long.count(ch)) for ch in set(short))
    if 200.0 * common <= floor * (m + common):
        return 0.0
    starts = range(-m + 1, n)
    best = max(ratio(short, long[max(0, i) : i + m]) for i in starts)
    if m == n:
        best = max(best, max(ratio(long, short[max(0, i) : i + m]) for i in starts))
    return best


def word_set_ratio(a: str, b: str) -> float:
    """Ratio of the differing words, judged together with the shared ones; 100 when one set holds the other."""
    wa, wb = set(a.split()), set(b.split())
    if not wa or not wb:
        return 0.0
    both, only_a, only_b = wa & wb, " ".join(sorted(wa - wb)), " ".join(sorted(wb - wa))
    if both and (not only_a or not only_b):
        return 100.0
    shared = len(" ".join(sorted(both)))
    gap = 1 if shared else 0
    with_a, with_b = shared + gap + len(only_a), shared + gap + len(only_b)
    edits = len(only_a) + len(only_b) - 2 * lcs_length(only_a, only_b)
    best = 100.0 * (1 - edits / (with_a + with_b))
    if shared:
        best = max(best, 200.0 * shared / (shared + with_a), 200.0 * shared / (shared + with_b))
    return best


def word_window_ratio(a: str, b: str, floor: float = 0.0) -> float:
    """100 with any word in common, else the best window over the sorted words."""
    if not set(a.split()).isdisjoint(b.split()):
        return 100.0
    return window_ratio(sorted_words(a), sorted_words(b), floor)


def weighted_ratio(a: str, b: str, floor: float = 0.0) -> float:
    """Weighted ratio; a value below ``floor`` may come out lower than it is."""
    if not a or not b:
        return 0.0
    lengths = sorted((len(a), len(b)))
    spread = lengths[1] / lengths[0]
    if spread < 1.5:
        return max(ratio(a, b), 0.95 * max(ratio(sorted_words(a), sorted_words(b)), word_set_ratio(a, b)))
    scale = 0.9 if spread <= 8.0 else 0.6
    best = 200.0 * lengths[0] / sum(lengths)  # what the plain ratio could reach at most
    best = ratio(a, b) if best > floor else 0.0
    best = max(best, 0.95 * scale * word_window_ratio(a, b, max(best, floor) / (0.95 * scale)))
    return max(best, scale * window_ratio(a, b, max(best, floor) / scale))


@pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="float64")


@pandas_udf(DoubleType())
def weighted_ratio_udf(a: pd.Series, b: pd.Series, floor: pd.Series) -> pd.Series:
    """Null where a text is null."""
    return pd.Series([None if x is None or y is None else weighted_ratio(x, y, f) for x, y, f in zip(a, b, floor)], dtype="float64")


def word_sort_key(text: Column) -> Column:
    """White-space separated words in code point order; the ratio of two such keys is the word-sort ratio."""
    words = F.array_remove(F.split(strip(F.coalesce(text, F.lit(""))), r"(?U)[\s\x1c-\x1f]+"), "")
    return F.array_join(F.array_sort(words), " ")


def numbered(values: Column) -> Column:
    """The strings of an array with repeats numbered, so that sets of them count like multisets.

    The array is bound to a lambda variable, so it is built once; arrays without a repeat are not searched.
    """
    return F.transform(
        F.array(values),
        lambda vs: F.when(F.size(F.array_distinct(vs)) == F.size(vs), F.transform(vs, lambda g: F.concat(g, F.lit("0")))).otherwise(
            F.transform(vs, lambda g, i: F.concat(g, F.size(F.filter(F.slice(vs, F.lit(1), i), lambda h: h == g)).cast("string")))
        ),
    )[0]


def _pairs(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))


def grams(text: Column) -> Column:
    """Character pairs of the text padded with one blank at either end, repeats numbered."""
    return numbered(_pairs(F.concat(F.lit(" "), text, F.lit(" "))))


def inner_grams(text: Column) -> Column:
    """Character pairs of the text itself, repeats numbered; a text of one character has none."""
    return F.when(F.length(text) > 1, numbered(_pairs(text))).otherwise(F.array().cast("array<string>"))


def letters(text: Column) -> Column:
    """The characters of the text, repeats numbered."""
    return numbered(F.filter(F.split(text, ""), lambda c: c != ""))


def shared_grams_needed(total_length: Column, threshold: float) -> Column:
    """Grams two padded texts of this joint length must share for a ratio of at least ``threshold``.

    A common subsequence of L characters with d unmatched ones runs in at most d + 1 unbroken pieces, so at
    least L - d of the padded texts' pairs survive (blanks included).  L is at least threshold/200 of the
    joint length and d is the rest.
    """
    common = F.ceil(total_length * (threshold / 200.0) - 1e-9)
    return F.greatest(F.lit(1), 3 * common + 1 - total_length).cast("int")


def alike_needs(threshold: float, lengths: int) -> list[int]:
    """For each length the fewest grams shared with any text whose length allows the ratio ``threshold``."""
    out = [1]
    for a in range(1, lengths + 1):
        partners = [b for b in range(1, 2 * a + 2) if min(a, b) * 200.0 >= (a + b) * (threshold - 1e-6)]
        out.append(max(1, min(3 * math.ceil((a + b) * threshold / 200.0 - 1e-9) + 1 - a - b for b in partners)))
    return out


def window_needs(threshold: float, lengths: int, pairs: bool) -> list[int]:
    """For each length m of the shorter text, the character pairs (or characters) that it shares at least with a longer one
    of which some stretch of s <= m characters has a ratio of ``threshold`` with it; ``m + 1`` where no stretch can.

    A common subsequence of c characters leaves m + s - 2 c unmatched, so it keeps 3 c - m - s - 1 pairs whole.
    """
    out = [0]
    for m in range(1, lengths + 1):
        common = [(c, s) for s in range(1, m + 1) if (c := math.ceil((m + s) * threshold / 200.0 - 1e-9)) <= s]
        out.append(max(0, min((3 * c - m - s - 1 if pairs else c for c, s in common), default=m + 1)))
    return out


def only_whole(threshold: float, lengths: int) -> int:
    """The largest length up to which a text has a window ratio of ``threshold`` only with texts that contain it whole."""
    for m in range(1, lengths + 1):
        if any(math.ceil((m + s) * threshold / 200.0 - 1e-9) <= s for s in range(1, m)) or (m - 1) * 2 * 100.0 >= 2 * m * threshold:
            return m - 1
    return lengths
