"""Mixing sources to target weights by Poisson replication.

A source with target share w of a budget of B characters and s characters of its own is to be repeated r = w * B / s
times on average.  Every document draws its number of copies from the Poisson distribution of mean r by inverting the
distribution function at a uniform number hashed from seed and document, so the draw is the same on every run,
partitioning and retry.  Means above ``BLOCK`` are split into equal parts drawn apart and summed, so that exp(-mean)
stays exact and the inversion short at any mean.  Copies are dealt to partitions by a hash of seed, document and copy
number and sorted by it inside: a global shuffle in one exchange, with no sampling pass.

Sources are summed by partial aggregation and written (a row a source).  Up to ``FEW_SOURCES`` of them are broadcast;
more are joined by a shuffle whose hot partitions adaptive execution splits.  A null source is a source of its own; weights are normalised over
the sources present, sources without a weight or without characters get none of the budget (documents of empty texts
keep rate 0); repeated rows draw alike; null ids draw from the text's hash alone; extra columns pass through, also where
their names clash with words used here; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sofralytics.llm.common import fresh, saved

BLOCK, SEED, FEW_SOURCES = 16.0, 42, 100_000
_HASH_BITS = 52


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the md5 of the parts."""
    digits = F.substring(F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])), 1, _HASH_BITS // 4)
    return (F.conv(digits, 16, 10).cast("bigint") + 0.5) / float(1 << _HASH_BITS)


def poisson(u: Column, mean: Column) -> Column:
    """The smallest k whose distribution function reaches ``u``; ``mean`` is at most ``BLOCK``.

    The walk ends where further terms no longer change the sum: 12 times the mean plus 60 terms is far beyond that.
    """
    first = F.exp(-mean)
    start = F.struct(F.lit(0).alias("k"), first.alias("p"), first.alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        p = acc["p"] * mean / i
        more = acc["sum"] < u
        return F.struct(
            F.when(more, i).otherwise(acc["k"]).alias("k"), F.when(more, p).otherwise(acc["p"]).alias("p"), F.when(more, acc["sum"] + p).otherwise(acc["sum"]).alias("sum")
        )

    terms = F.sequence(F.lit(1), (mean * 12 + 60).cast("int"))
    return F.when(u <= first, F.lit(0)).otherwise(F.aggregate(terms, start, step, lambda acc: acc["k"]))


def copies(mean: Column, *key: Column) -> Column:
    """Poisson number of copies: a sum of independent draws of mean at most ``BLOCK``."""
    parts = F.greatest(F.ceil(mean / BLOCK).cast("int"), F.lit(1))
    draws = F.transform(F.sequence(F.lit(1), parts), lambda i: poisson(uniform(*key, i), mean / parts))
    return F.aggregate(draws, F.lit(0), lambda acc, k: acc + k)


def rates(docs: DataFrame, weights: DataFrame | None, temperature: float, budget: float | None, names: tuple[str, str] = ("_source", "_rate")) -> DataFrame:
    """The source and the rate of every source, under the given names.

    ``weights`` has (source, weight); without it the weight is the source's characters to the power ``temperature``.
    ``budget`` is the number of characters to return in the mean, by default as many as there are.
    """
    sizes = docs.groupBy(F.col("source").alias("_source")).agg(F.sum(F.length(F.coalesce("text", F.lit(""))).cast("bigint")).alias("_chars"))
    if weights is None:
        weighed = sizes.withColumn("_weight", F.pow(F.col("_chars").cast("double"), F.lit(temperature)))
    else:
        asked = weights.select(F.col("source").alias("_asked"), F.col("weight").cast("double").alias("_weight"))
        weighed = sizes.join(asked, F.col("_source").eqNullSafe(F.col("_asked")), "left").drop("_asked")
    weighed = weighed.withColumn("_weight", F.when((F.col("_chars") > 0) & (F.col("_weight") > 0), F.col("_weight")).otherwise(0.0))
    weighed = saved(weighed, "sources")
    total = weighed.agg(F.sum("_weight").alias("weight"), F.sum("_chars").alias("chars"), F.count("*").alias("n")).first()  # one row
    share = F.col("_weight") / F.lit(float(total["weight"] or 1.0))
    wanted = F.lit(float(total["chars"] or 0) if budget is None else float(budget))
    rate = F.when(F.col("_chars") > 0, share * wanted / F.col("_chars")).otherwise(0.0)
    rated = weighed.select(F.col("_source").alias(names[0]), rate.alias(names[1]))
    return F.broadcast(rated) if total["n"] <= FEW_SOURCES else rated


def mix(docs: DataFrame, weights: DataFrame | None = None, temperature: float = 0.5, budget: float | None = None, seed: int = SEED) -> DataFrame:
    """The documents, each as often as drawn, in a global shuffle; further columns ``copy`` (from 1) and ``mix_key``.

    A column of the input named ``copy`` or ``mix_key`` is replaced.
    """
    own = [c for c in docs.columns if c not in ("copy", "mix_key")]
    source, rate, drawn = (fresh(docs, n) for n in ("_source", "_rate", "_copies"))
    rated = rates(docs, weights, temperature, budget, (source, rate))
    key = (F.lit(seed), F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.xxhash64("text")))
    rows = docs.select(*own).join(rated, F.col("source").eqNullSafe(F.col(source)))
    rows = rows.withColumn(drawn, copies(F.col(rate), *key)).where(F.col(drawn) > 0)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(drawn))))
    rows = rows.withColumn("mix_key", F.xxhash64(F.lit(seed), "doc_id", "copy", F.when(F.col("doc_id").isNull(), F.xxhash64("text"))))
    return rows.select(*own, "copy", "mix_key").repartition("mix_key").sortWithinPartitions("mix_key")
