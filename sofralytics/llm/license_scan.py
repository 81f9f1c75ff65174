"""Licence scan: a trained paragraph classifier proposes a licence family, template comparison confirms it.

A paragraph is a line; a line that goes on in lower case after one without closing punctuation is joined to it.  Features
are the distinct two- and three-word runs that occur in the templates (a few thousand, so their weights are broadcast).
A multinomial logistic regression learns from templates with words dropped at random, and from paragraphs of no known
licence: fixed sentences and at most ``SAMPLE`` documents chosen by hash.  A temperature fitted on rows kept apart
calibrates its probabilities; what stays below ``ACCEPT`` or is likeliest of no family is unknown.  A proposal is
confirmed where the paragraph has at least ``CONTAINED`` of the three-word runs of one of the family's templates.

Scoring is columns only: runs are hashed, met with the weights by a broadcast join, and summed for each paragraph by
partial aggregation; runs that no template has never leave their task.

Null and empty texts have no paragraphs and no licence; repeated rows are results of their own; ties go to the family
listed first; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sofralytics.llm.common import saved
from sofralytics.llm.license_text import TEMPLATES, UNKNOWN

FAMILIES = ("unknown", *TEMPLATES)
VARIANTS, DROPPED_PCT, SAMPLE, PARAGRAPHS, SEED = 40, 12, 500, 4000, 5
ACCEPT, CONTAINED = 0.5, 0.5
TEMPERATURES = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0)
_MARK = 0  # stands for the document itself among its runs


def paragraphs(text: Column) -> Column:
    joined = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=[^\n.!?:;])\r?\n(?=[a-z])", " ")
    return F.filter(F.split(joined, r"\r?\n"), lambda p: p.rlike("[^\\s]"))


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once; a lambda would work it out again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def runs_of(words: Column, size: int) -> Column:
    """Hashes of the runs of ``size`` words; ``words`` is a column or a variable."""
    starts = F.sequence(F.lit(0), F.size(words) - size)
    hashed = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
    return F.when(F.size(words) >= size, hashed).otherwise(F.array().cast("array<bigint>"))


def distinct_runs(text: Column) -> Column:
    """Hashes of the distinct two- and three-word runs of a text."""
    return bound(word_list(text), lambda w: F.array_distinct(F.concat(runs_of(w, 2), runs_of(w, 3))))


def distinct_triples(text: Column) -> Column:
    return bound(word_list(text), lambda w: F.array_distinct(runs_of(w, 3)))


def templates(spark: SparkSession) -> DataFrame:
    """(template, family, text): one row a template, numbered in the order of listing."""
    rows = [(i, FAMILIES.index(f), t) for i, (f, t) in enumerate((f, t) for f, texts in TEMPLATES.items() for t in texts)]
    return spark.createDataFrame(rows, "template int, family int, text string")


def probabilities(logits: Column, temperature: float) -> Column:
    top = F.array_max(logits)
    raised = F.transform(logits, lambda x: F.exp((x - top) / temperature))
    return bound(raised, lambda r: bound(F.aggregate(r, F.lit(0.0), lambda acc, y: acc + y), lambda total: F.transform(r, lambda x: x / total)))


class Model:
    """Weights of the runs, templates' runs and the temperature."""

    def __init__(self, table: DataFrame, bias: list[float], sizes: list[int], families: list[int], temperature: float):
        self.table, self.bias, self.sizes, self.families, self.temperature = table, bias, sizes, families, temperature

    def sums(self) -> list[Column]:
        """Aggregates: the evidence for each family, and how many runs of each template are there."""
        evidence = [F.sum(F.get("weights", F.lit(k))).alias(f"e{k}") for k in range(len(self.bias))]
        shared = [F.sum(F.when(F.array_contains("held_by", t), 1).otherwise(0)).alias(f"t{t}") for t in range(len(self.sizes))]
        return evidence + shared

    def evidence(self) -> Column:
        """The families' logits before the temperature."""
        return F.array(*[F.col(f"e{k}") + F.lit(b) for k, b in enumerate(self.bias)])

    def best_template(self) -> Column:
        """struct<containment, template> of the proposed family's template that is held most."""
        shares = [
            F.when(F.col("family") == f, F.struct((F.col(f"t{t}") / n).alias("containment"), F.lit(-t).alias("template")))
            for t, (f, n) in enumerate(zip(self.families, self.sizes, strict=True))
        ]
        return F.array_max(F.array(*shares))


def training_rows(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """(family, grams, part): variants of the templates and paragraphs of no licence; part 0 is kept for calibration."""
    spark = docs.sparkSession
    varied = listed.select("family", "template", word_list(F.col("text")).alias("words"), F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))).alias("v"))
    fate = lambda i: F.pmod(F.xxhash64(F.lit(SEED), "template", "v", i), F.lit(100).cast("bigint"))
    kept = F.filter("words", lambda w, i: (F.col("v") == 0) | (fate(i) >= DROPPED_PCT))
    known = varied.select("family", bound(kept, lambda w: F.array_distinct(F.concat(runs_of(w, 2), runs_of(w, 3)))).alias("grams"))
    plain = spark.createDataFrame([(t,) for t in UNKNOWN], "text string")
    chosen = docs.select("text").orderBy(F.xxhash64(F.lit(SEED), "text"), "text").limit(SAMPLE).select(F.explode(paragraphs(F.col("text"))).alias("text"))
    chosen = chosen.orderBy(F.xxhash64(F.lit(SEED), "text"), "text").limit(PARAGRAPHS)
    triples = distinct_triples(F.col("text"))
    known_triples = sorted({t for r in listed.select(triples.alias("t")).collect() for t in r["t"]})
    lines = chosen.unionByName(plain).select(distinct_runs(F.col("text")).alias("grams"), triples.alias("triples"))
    lines = lines.select("grams", F.size("triples").alias("n"), F.size(F.array_intersect("triples", F.lit(known_triples))).alias("shared"))
    lines = saved(lines, "lines")  # a filter would else be pushed down and work the runs out again
    none = lines.where((F.col("shared") < 3) & (2 * F.col("shared") <= F.col("n"))).select(F.lit(0).alias("family"), "grams")
    return known.unionByName(none).withColumn("part", F.pmod(F.xxhash64("grams", F.lit(SEED)), F.lit(5).cast("bigint")))


def train(docs: DataFrame) -> Model:
    spark = docs.sparkSession
    listed = templates(spark)
    held = [(r["family"], list(r["grams"]), set(r["triples"])) for r in listed.orderBy("template").select("family", distinct_runs(F.col("text")).alias("grams"), distinct_triples(F.col("text")).alias("triples")).collect()]
    grams = sorted({g for _, gs, _ in held for g in gs})
    rows = saved(training_rows(docs, listed), "licences")
    counted = CountVectorizerModel.from_vocabulary([str(g) for g in grams], inputCol="grams", outputCol="features", minTF=1.0).setBinary(True)
    vectors = counted.transform(rows.select("family", "part", F.transform("grams", lambda g: g.cast("string")).alias("grams")))
    learner = LogisticRegression(featuresCol="features", labelCol="family", family="multinomial", regParam=0.003, maxIter=60)
    fitted = learner.fit(vectors.where("part > 0").select("features", "family").coalesce(4))
    weights, bias = fitted.coefficientMatrix.toArray(), [float(b) for b in fitted.interceptVector]
    entries = [(g, [float(w) for w in weights[:, i]], [t for t, (_, _, triples) in enumerate(held) if g in triples]) for i, g in enumerate(grams)]
    entries.append((_MARK, [0.0] * len(bias), []))
    schema = T.StructType.fromDDL("gram bigint, weights array<double>, held_by array<int>")
    table = saved(spark.createDataFrame(entries, schema), "weights")
    model = Model(table, bias, [max(len(t), 1) for _, _, t in held], [f for f, _, _ in held], 1.0)
    apart = rows.where("part = 0").withColumn("row", F.monotonically_increasing_id()).select("row", "family", F.explode_outer("grams").alias("gram"))
    summed = apart.join(F.broadcast(table), "gram").groupBy("row", "family").agg(*model.sums())
    judged = saved(summed.select("family", model.evidence().alias("logits")), "apart")
    losses = judged.agg(*[F.avg(-F.log(F.get(probabilities(F.col("logits"), t), F.col("family")) + 1e-12)).alias(f"l{i}") for i, t in enumerate(TEMPERATURES)]).first()
    known = [(loss, t) for loss, t in zip(losses, TEMPERATURES, strict=True) if loss is not None]
    model.temperature = min(known)[1] if known else 1.0
    return model


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: ``doc_id``, ``n_paragraphs``, ``license``, ``probability`` and ``found``.

    ``found`` lists the paragraphs with a licence: number, family, probability, template, containment, confirmed.
    ``license`` is the family of the likeliest confirmed paragraph, or unknown.
    """
    lines = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", paragraphs(F.col("text")).alias("lines"))
    own = F.flatten(F.transform("lines", lambda line, i: F.transform(distinct_runs(line), lambda g: F.struct(i.alias("paragraph"), g.alias("gram")))))
    mark = F.array(F.struct(F.lit(-1).alias("paragraph"), F.lit(_MARK).cast("bigint").alias("gram")))
    spread = lines.select("row", "doc_id", F.size("lines").alias("n_paragraphs"), F.explode(F.concat(own, mark)).alias("e"))
    spread = spread.select("row", "doc_id", "n_paragraphs", "e.paragraph", "e.gram")
    summed = spread.join(F.broadcast(model.table), "gram").groupBy("row", "doc_id", "n_paragraphs", "paragraph").agg(*model.sums())
    likely = summed.withColumn("logits", model.evidence()).withColumn("p", probabilities(F.col("logits"), model.temperature)).withColumn("probability", F.array_max("p"))
    likely = likely.withColumn("family", F.when(F.col("probability") >= ACCEPT, F.array_position("p", F.col("probability")).cast("int") - 1).otherwise(0))
    likely = likely.withColumn("_best", model.best_template())
    names = F.array(*[F.lit(f) for f in FAMILIES])
    entry = F.struct(
        "paragraph", F.element_at(names, F.col("family") + 1).alias("family"), "probability", (-F.col("_best.template")).alias("template"),
        F.col("_best.containment").alias("containment"), (F.col("_best.containment") >= CONTAINED).alias("confirmed"),
    )
    found = F.array_sort(F.collect_list(F.when((F.col("paragraph") >= 0) & (F.col("family") > 0), entry)))
    gathered = likely.groupBy("row", "doc_id", "n_paragraphs").agg(found.alias("found"))
    best = F.array_max(F.transform(F.filter("found", lambda x: x["confirmed"]), lambda x: F.struct(x["probability"], (-x["paragraph"]).alias("first"), x["family"].alias("family"))))
    out = gathered.withColumn("_best", best)
    return out.select("doc_id", "n_paragraphs", F.coalesce("_best.family", F.lit("unknown")).alias("license"), F.col("_best.probability").alias("probability"), "found")
