"""URL filter: a rule list decides first, gradient-boosted trees on lexical features decide the rest.

The host is what stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path
goes on to the next ``?``, ``#`` or end.  A rule ``host/path`` fits its host and all subdomains where the path starts
with the rule's; the longest rule wins (of equal rules with two verdicts: block).  Rules are a list held in the plan.

The trees learn from distinct labelled URLs: at most ``SAMPLE`` of them, chosen by hash.  Suffix statistics are the
smoothed share of blocked URLs for each last host label, counted over all labelled URLs; they are broadcast only where
they are few.

A null URL or one without ``://`` has an empty host and path, fits no rule and is judged by its features; repeated rows get
equal verdicts; labels other than 0 and 1 do not teach; without both labels the share of blocked URLs (none: 0) decides; an empty
table gives an empty table; ids and further columns are passed through by the caller's select.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sofralytics.llm.common import ascii_lower, saved
from sofralytics.operators.sizing import bounded

SAMPLE, TREES, DEPTH, SEED, SMOOTHING, THRESHOLD = 20_000, 20, 4, 11, 10.0, 0.5
FEATURES = ("length", "depth", "digit_ratio", "entropy", "parameters", "host_labels", "path_length", "suffix_rate", "suffix_log_count")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return ascii_lower(host), path


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct<size, rule, verdict> of the longest rule that fits, or null."""
    fitting = []
    for rule, verdict in rules:
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(slash + rest))
        fitting.append(F.when(fits, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fitting)) if fitting else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def entropy(text: Column) -> Column:
    """Bits per character: each distinct character is counted by taking it out."""
    size = F.length(text)

    def term(acc: Column, c: Column) -> Column:
        share = (size - F.length(F.replace(text, c, F.lit("")))) / size
        return acc - share * F.log2(share)

    return F.when(size > 0, F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda acc, c: F.when(c == "", acc).otherwise(term(acc, c)))).otherwise(0.0)


def lexical(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host``, ``path``, ``suffix`` and the features that need no statistics."""
    text = F.coalesce(F.col(url), F.lit(""))
    host, path = host_and_path(F.col(url))
    held = urls.withColumns({"host": host, "path": path})
    size = F.length(text)
    return held.withColumns({
        "suffix": F.substring_index("host", ".", -1),
        "length": size.cast("double"),
        "depth": F.length(F.regexp_replace("path", "[^/]", "")).cast("double"),
        "digit_ratio": F.when(size > 0, F.length(F.regexp_replace(text, "[^0-9]", "")) / size).otherwise(0.0),
        "entropy": entropy(text),
        "parameters": F.length(F.regexp_replace(F.regexp_extract(text, r"\?([^#]*)", 1), "[^=]", "")).cast("double"),
        "host_labels": F.size(F.split("host", "\\.")).cast("double"),
        "path_length": F.length("path").cast("double"),
    })


class Model:
    """Suffix statistics and boosted trees, or a constant share where the labels do not tell classes apart."""

    def __init__(self, suffixes: DataFrame | None, trees, share: float):
        self.suffixes, self.trees, self.share = suffixes, trees, share

    def with_statistics(self, urls: DataFrame) -> DataFrame:
        known = bounded(self.suffixes.select(F.col("suffix").alias("_suffix"), "suffix_rate", "suffix_log_count"))
        joined = urls.join(known, urls["suffix"] == known["_suffix"], "left").drop("_suffix")
        return joined.fillna({"suffix_rate": self.share, "suffix_log_count": 0.0})

    def block_probability(self, urls: DataFrame) -> DataFrame:
        """Adds ``p_block`` to rows made by ``lexical``."""
        if self.trees is None:
            return urls.withColumn("p_block", F.lit(self.share))
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(self.with_statistics(urls))
        judged = self.trees.transform(vectors)
        return judged.withColumn("p_block", vector_to_array("_probability")[1]).drop("_features", "_raw", "_probability", "_prediction", "suffix_rate", "suffix_log_count")


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from rows (url, label: 1 is blocked)."""
    known = labelled.where(F.col("label").isin(0, 1)).select("url", F.col("label").cast("double").alias("label"))
    counted = known.groupBy(F.substring_index(host_and_path(F.col("url"))[0], ".", -1).alias("suffix")).agg(F.sum("label").alias("blocked"), F.count("*").alias("n"))
    counted = saved(counted, "counted")
    seen = counted.agg(F.sum("n").alias("n"), (F.sum("blocked") / F.sum("n")).alias("share")).first()
    if not seen["n"] or seen["share"] in (0.0, 1.0):
        return Model(None, None, float(seen["share"] or 0.0))
    share = float(seen["share"])
    rate = (F.col("blocked") + SMOOTHING * share) / (F.col("n") + SMOOTHING)
    model = Model(counted.select("suffix", rate.alias("suffix_rate"), F.log1p("n").alias("suffix_log_count")), None, share)
    chosen = known.distinct().orderBy(F.xxhash64(F.lit(SEED), "url"), "url", "label").limit(sample)
    rows = saved(lexical(chosen), "urls")
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(model.with_statistics(rows)).select("_features", "label")
    learner = GBTClassifier(
        featuresCol="_features", labelCol="label", predictionCol="_prediction", maxIter=TREES, maxDepth=DEPTH, seed=SEED, checkpointInterval=-1
    )
    learner.setRawPredictionCol("_raw").setProbabilityCol("_probability")
    model.trees = learner.fit(vectors.coalesce(4))
    return model


def judge(urls: DataFrame, rules: list[tuple[str, str]], model: Model) -> DataFrame:
    """Adds ``host``, ``path``, the ``rule`` that fits (or null), ``p_block`` and ``verdict`` to (id and) ``url`` rows."""
    scored = model.block_probability(lexical(urls))
    hit = longest_rule(F.col("host"), F.col("path"), rules)
    by_trees = F.when(F.col("p_block") >= THRESHOLD, "block").otherwise("allow")
    held = scored.withColumn("_hit", hit)
    return held.withColumns({"rule": F.col("_hit.rule"), "verdict": F.coalesce("_hit.verdict", by_trees)}).drop("_hit")


def labelled_by_rules(urls: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(url, label) of the URLs that the rule list decides: the labelled set where no other is given."""
    host, path = host_and_path(F.col("url"))
    held = urls.select("url", longest_rule(host, path, rules).alias("_hit")).where(F.col("_hit").isNotNull())
    return held.select("url", (F.col("_hit.verdict") == "block").cast("int").alias("label"))
