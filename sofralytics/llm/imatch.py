"""I-Match document fingerprints over randomised lexicon subsets, and likeness of neighbouring documents.

Terms are lower-cased runs of letters and digits.  The lexicon holds the terms whose share of documents lies between
``low`` and ``high``, that is a band of inverse document frequency.  ``low`` is at least mean terms / ``LEXICON``, so the
lexicon has at most ``LEXICON`` terms whatever the corpus: terms above a share of x are at most (mean terms) / x.  That
bound is why it is broadcast.

A fingerprint is a list of hashes: of a text's sorted distinct lexicon terms, and of those that each of several random
subsets of the lexicon keeps.  Subsets come in chains, each half of the one before, so that for a text of any length some
keep few enough of its terms to survive an edit.  Likeness is the share of equal hashes among the subsets that keep a
term of either text.  A text without lexicon terms is hashed whole in every place, so equal texts have equal
fingerprints always.

The next document needs neighbours in the order of ids: rows are dealt to ranges of about ``RANGE`` ids and sorted inside;
each range gets a copy of the next range's first row, so texts are shuffled once.  Null texts count as empty, null ids
come last, rows of equal id are ordered by text; repeated rows are neighbours; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sofralytics.llm.common import saved

LOW, HIGH, LEXICON = 0.001, 0.2, 1_000_000
CHAINS = ((1, 2, 2), (3, 9, 8))  # first and last level, number of chains; a level keeps a share of 1 / 2**level
DIGITS = 6
RANGE, CUTS = 2000, 64
_MARK = 0  # stands for the document itself among its terms


def terms(text: Column) -> Column:
    """Sorted hashes of the distinct terms of a text."""
    found = F.array_distinct(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"))
    return F.array_sort(F.transform(F.filter(found, lambda t: t != ""), lambda t: F.xxhash64(t)))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH, limit: int = LEXICON) -> DataFrame:
    """(term, n): term hashes in the band and their numbers of documents."""
    counted = docs.select(F.explode(terms(F.coalesce("text", F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    counted = saved(counted, "terms")
    n = docs.count()
    total = counted.agg(F.sum("n")).first()[0] or 0
    least = max(low * n, total / limit, 2)
    return counted.where((F.col("n") >= F.lit(float(least))) & (F.col("n") <= F.lit(float(max(high * n, 2)))))


def hashes(found: Column, whole: Column) -> Column:
    """The fingerprint of sorted lexicon terms: the hash of all, then of each subset's, null where it keeps none."""
    parts = [F.array(F.when(F.size(found) > 0, F.xxhash64(found)))]
    for first, last, count in CHAINS:
        parts += [chain(found, seed, first, last) for seed in range(count)]
    every = F.concat(*parts)
    return F.when(F.size(found) == 0, F.array_repeat(whole, 1 + sum((b - a + 1) * n for a, b, n in CHAINS))).otherwise(every)


def chain(found: Column, seed: int, level: int, last: int) -> Column:
    """The hashes of a chain of subsets, each half of the one before; each is worked out from that one."""
    mask = F.lit((1 << level) - 1).cast("bigint")
    kept = F.filter(found, lambda t: F.xxhash64(t, F.lit(seed)).bitwiseAND(mask) == 0)

    def hashed(own: Column) -> Column:
        here = F.array(F.when(F.size(own) > 0, F.xxhash64(own)))
        return here if level == last else F.concat(here, chain(own, seed, level + 1, last))

    return F.get(F.transform(F.array(kept), hashed), F.lit(0))  # binds the subset, so that it is worked out once


def likeness(a: Column, b: Column) -> Column:
    """The share of equal hashes among the places where either list has one."""
    pairs = F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: p["a"].isNotNull() | p["b"].isNotNull())
    return F.size(F.filter(pairs, lambda p: F.coalesce(p["a"] == p["b"], F.lit(False)))) / F.size(pairs)


def written(values: Column) -> Column:
    """The last ``DIGITS`` hexadecimal digits of each hash; dots where there is none."""
    digits = F.transform(values, lambda h: F.coalesce(F.right(F.lpad(F.lower(F.hex(h)), 16, "0"), F.lit(DIGITS)), F.lit("." * DIGITS)))
    return F.array_join(digits, "")


def ranges(docs: DataFrame, rows: int = RANGE) -> Column:
    """A number that grows with the id and is shared by about ``rows`` ids; -1 for null ids.

    Quantiles of the ids cut coarse ranges, each of which is cut evenly.
    """
    cuts = docs.agg(F.percentile_approx("doc_id", F.lit([i / CUTS for i in range(CUTS + 1)]), 10_000).alias("at"), F.count("*").alias("n")).first()
    if not cuts["at"]:
        return F.lit(-1).cast("bigint")
    edges = sorted({int(x) for x in cuts["at"]})
    pieces = max(1, -(-int(cuts["n"]) // (CUTS * rows)))
    starts = F.lit(edges).cast("array<bigint>")
    coarse = F.greatest(F.aggregate(starts, F.lit(0), lambda acc, e: acc + F.when(F.col("doc_id") >= e, 1).otherwise(0)), F.lit(1))
    first = F.element_at(starts, coarse)
    width = F.greatest((F.element_at(starts, F.least(coarse + 1, F.lit(len(edges)))) - first) / pieces, F.lit(1.0))
    fine = F.least(F.greatest(F.floor((F.col("doc_id") - first) / width), F.lit(0)), F.lit(pieces - 1))
    return F.coalesce((coarse * pieces + fine).cast("bigint"), F.lit(-1).cast("bigint"))


def with_first_of_next(docs: DataFrame, rows: int = RANGE) -> DataFrame:
    """(range, doc_id, tie, text, copied): all rows, and for each range a copy of the first row of the next one down.

    The last range is followed by the first.
    """
    text = F.coalesce("text", F.lit(""))
    kept = docs.select(ranges(docs, rows).alias("range"), "doc_id", F.xxhash64(text).alias("tie"), text.alias("text"))
    heads = saved(kept.groupBy("range").agg(F.max(F.struct("doc_id", "tie")).alias("head")).select("range", "head.doc_id", "head.tie"), "heads")
    down = Window.orderBy(F.col("range").desc())  # a row for each range
    back = Window.orderBy("range")
    above = F.coalesce(F.lag("range").over(down), F.first("range").over(back)).alias("above")  # the first range follows the last
    heads = saved(heads.select(above, "range", F.col("doc_id").alias("_id"), F.col("tie").alias("_tie")), "heads")
    first_rows = kept.join(heads, (kept["range"] == heads["range"]) & kept["doc_id"].eqNullSafe(heads["_id"]) & (kept["tie"] == heads["_tie"]))
    copies = first_rows.groupBy("above", "doc_id", "tie").agg(F.first("text").alias("text")).select(F.col("above").alias("range"), "doc_id", "tie", "text", F.lit(1).alias("copied"))
    return kept.withColumn("copied", F.lit(0)).unionByName(copies)


def neighbours(docs: DataFrame, low: float = LOW, high: float = HIGH, rows: int = RANGE) -> DataFrame:
    """``doc_id``, ``n_chars``, ``edited_sha256``, ``found`` (hashes of the text), ``edited_found`` and ``next_found``.

    The edited text has its last half replaced by as much of the beginning of the next document, in descending ids.
    """
    spark = docs.sparkSession
    known = lexicon(docs, low, high).select("term").unionByName(spark.range(1).select(F.lit(_MARK).cast("bigint").alias("term")))
    order = Window.partitionBy("range").orderBy("copied", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    held = with_first_of_next(docs, rows).withColumns({"next": F.coalesce(F.lead("text").over(order), F.lit("")), "row": F.row_number().over(order)})
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next", F.lit(1), half))
    held = held.select("range", "row", "copied", "doc_id", "text", edited.alias("edited"))
    about = F.struct(
        "copied", "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.xxhash64("text").alias("whole"), F.xxhash64("edited").alias("edited_whole")
    )
    # the terms of both texts and one mark for the document, met with the lexicon and gathered again in their own partition
    none = F.lit(None).cast(held.select(about.alias("about")).schema["about"].dataType)
    entry = lambda of, term, about: F.struct(F.lit(of).alias("of"), term.alias("term"), about.alias("about"))
    entries = F.concat(
        F.transform(terms(F.col("text")), lambda t: entry(0, t, none)),
        F.transform(terms(F.col("edited")), lambda t: entry(1, t, none)),
        F.array(entry(2, F.lit(_MARK).cast("bigint"), about)),
    )
    spread = held.select("range", "row", F.explode(entries).alias("e")).select("range", "row", "e.of", "e.term", "e.about")
    met = spread.join(F.broadcast(known.distinct()), "term", "left_semi")
    own = lambda of: F.array_sort(F.collect_list(F.when(F.col("of") == of, F.col("term"))))
    gathered = met.groupBy("range", "row").agg(F.max("about").alias("about"), own(0).alias("terms"), own(1).alias("edited_terms"))
    found = gathered.select(
        "range", "row", "about.*", hashes(F.col("terms"), F.col("about.whole")).alias("found"), hashes(F.col("edited_terms"), F.col("about.edited_whole")).alias("edited_found")
    )
    found = found.withColumn("next_found", F.lead("found").over(Window.partitionBy("range").orderBy("row")))
    return found.where(F.col("copied") == 0).select("doc_id", "n_chars", "edited_sha256", "found", "edited_found", "next_found")
