"""Near copies by the exact similarity of word shingles, and the components their links make.

Two texts are linked where the Jaccard similarity of their sets of five-word shingles is at least 4/5; a text of fewer
words is one shingle.  Shingles are 64-bit hashes.  With shingles in one fixed order, two such sets share one of the
first ``n - ceil(4n/5) + 1`` of each, so these are the index; shingles that many of a sample of documents have come last
in the order, which makes candidates few and changes no result.

Each set has a sketch: the parity of its hashes in ``PARITY`` classes.  Two sketches differ in no more bits than the sets
have hashes apart, and similar sets have at most a ninth of all apart, so most candidates are dropped without their
sets and none wrongly; what is left is compared hash by hash.

Equal sets are one.  SimHash links come first: sets whose fingerprints over the same five-word shingles are within
``simhash.MAX_BITS`` bits are found by the deletion variants of ``op5_simhash``, one spanning forest a group, and kept
where the sets are similar.  Four of 64 bits miss most pairs near the threshold, so an exact check over the index follows
for what they leave apart.  Under each index entry all sets are first compared with its smallest.  Then those of an entry that
are not connected yet are compared inside tasks, sketch against sketch: once a spanning forest of the pairs that pass
leaves a task, so a large group of near copies gives few pairs; and, when these are compared hash by hash, once every pair
that passes and is still not connected, so nothing is lost where a pair of the forest was not similar after all.  An
entry of many sets is dealt to pairs of chunks, so it is many groups.  Which sets are connected is thus kept exactly.

Null texts and texts without a word are equal sets; rows, ids and empty tables as in ``simhash``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sofralytics.llm import simhash
from sofralytics.llm.common import arrow_rows, mapped, saved, setting, word_blocks, working

WIDTH, SHARE = 5, (4, 5)
PARITY, CHUNK = 2048, 1024
SAMPLED, FREQUENT, LISTED = 8, 3, 100_000  # the order's sample: one document of so many; what has so many; at most so many
_STEP = np.uint64(0x9E3779B97F4A7C15)
Keep = Callable[[DataFrame, str], DataFrame]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles of ``width`` words (A-Z lower-cased)."""
    digest = xxhash.xxh64_intdigest
    parts = [np.fromiter(map(digest, block), np.uint64, len(block)) for block in word_blocks(text.lower())]
    words = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    width = min(width, len(words))
    if not width:
        return words
    out = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        out = _mixed(out * _STEP + words[k : k + len(out)])
    return np.unique(out)


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))


def parity(held: np.ndarray) -> bytes:
    return np.packbits((np.bincount((held % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1).astype(bool)).tobytes()


def prints(docs: DataFrame) -> DataFrame:
    """Of every row ``doc_id``, ``text_hash`` (of the whole text, null as empty), ``fp``, the hash of the set, ``n``, ``sketch`` and ``mark``, the SimHash."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sizes, sketches, marks = [], [], [], []
            for t in batch.column(2).to_pylist():
                held = shingles(t)
                fps.append(xxhash.xxh64_intdigest(held.tobytes()))
                sizes.append(len(held))
                sketches.append(parity(held))
                marks.append(simhash.fingerprint(t, WIDTH))
            columns = [pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary())]
            columns.append(pa.array(np.array(marks, dtype=np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "text_hash", "fp", "n", "sketch", "mark"])

    return mapped(_texts(docs), run, f"doc_id {kind}, text_hash bigint, fp bigint, n int, sketch binary, mark bigint", "prints")


def frequent(docs: DataFrame) -> np.ndarray:
    """The most frequent shingles of a sample of documents, rarest first."""
    sample = _texts(docs).where(F.pmod("text_hash", F.lit(SAMPLED).cast("bigint")) == 0).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t).view(np.int64))], names=["key"])

    spark = docs.sparkSession
    with arrow_rows(spark, 256), setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        counted = sample.mapInArrow(run, "key bigint").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
        rows = counted.orderBy(F.desc("n"), "key").limit(LISTED).collect()
    return np.array([r["key"] for r in reversed(rows)], dtype=np.int64).view(np.uint64)


def entries(docs: DataFrame, last: np.ndarray, keep: Keep) -> DataFrame:
    """(key, fp): the first shingles of every row's set; those in ``last`` come after all others, in its order."""
    by_hash = np.argsort(last)
    listed = last[by_hash]
    top, whole = SHARE

    def first(held: np.ndarray) -> np.ndarray:
        n = len(held) - -(-top * len(held) // whole) + 1
        if not len(listed):
            return held[:n]
        at = np.minimum(np.searchsorted(listed, held), len(listed) - 1)
        rank = np.where(listed[at] == held, by_hash[at] + 1, 0)
        return held[np.argsort(rank, kind="stable")[:n]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, fps = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
            for t in batch.column(0).to_pylist():
                held = shingles(t)
                if len(held):
                    keys.append(first(held))
                    fps.append(np.full(len(keys[-1]), xxhash.xxh64_intdigest(held.tobytes()), np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (keys, fps)], names=["key", "fp"])

    return mapped(_texts(docs).select("text"), run, "key bigint, fp bigint", "entries", keep=keep)


def sets_of(docs: DataFrame, found: DataFrame, wanted: DataFrame) -> DataFrame:
    """``fp`` and ``held`` (sorted hashes) of the wanted sets, read from one row of each."""
    rows = found.groupBy("fp").agg(F.min(F.struct("doc_id", "text_hash")).alias("_key")).join(wanted, "fp", "left_semi")
    texts = _texts(docs).withColumn("_key", F.struct("doc_id", "text_hash")).join(rows.select("_key"), "_key", "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [shingles(t) for t in batch.column(0).to_pylist()]
            fp = np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in held], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array([h.tobytes() for h in held], pa.binary())], names=["fp", "held"])

    return texts.mapInArrow(run, "fp bigint, held binary").groupBy("fp").agg(F.first("held").alias("held"))


def _paired(pairs: DataFrame, values: DataFrame, *names: str) -> DataFrame:
    """The pairs (a, b) with the named values of both: those of a, then those of b."""
    for side in ("a", "b"):
        pairs = pairs.join(values.select(F.col("fp").alias(side), *[F.col(x).alias(f"{x}_{side}") for x in names]), side)
    return pairs.select("a", "b", *[f"{x}_{side}" for side in ("a", "b") for x in names])


def fits(n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which sets (sizes n and m, sketches x and y) may be similar: at most |A| + |B| - 2 |A and B| bits differ."""
    top, whole = SHARE
    out = whole * np.minimum(n, m) >= top * np.maximum(n, m)
    left = np.flatnonzero(out)
    apart = np.bitwise_count(x[left] ^ y[left]).sum(axis=1, dtype=np.int64)
    out[left] = (whole + top) * apart <= (whole - top) * (n[left] + m[left])
    return out


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, PARITY // 64)


def close(pairs: DataFrame, sketches: DataFrame, keep: Keep) -> DataFrame:
    """The pairs (a, b) whose sketches allow similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 4))
            yield batch.select([0, 1]).filter(pa.array(fits(n, m, _sketches(batch.column(3)), _sketches(batch.column(5)))))

    return mapped(_paired(pairs, sketches, "n", "sketch"), run, "a bigint, b bigint", "close", rows=4096, keep=keep)


def alike(pairs: DataFrame, docs: DataFrame, found: DataFrame, keep: Keep) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, compared hash by hash."""
    top, whole = SHARE
    with arrow_rows(docs.sparkSession, 256):
        sets = keep(sets_of(docs, found, pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()), "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                same.append(whole * common >= top * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(same, pa.bool_()))

    return mapped(_paired(pairs, sets, "held"), run, "a bigint, b bigint", "alike", rows=32)  # a row holds two whole sets


def shared(docs: DataFrame, keep: Keep) -> DataFrame:
    """(key, low, fp): the index entries that more than one set has, with the smallest of these sets."""
    with working(docs.sparkSession) as brief:
        index = entries(docs, frequent(docs), brief)
        low = index.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where(F.col("low") < F.col("high"))
        return keep(index.join(brief(low.select("key", "low"), "low"), "key").select("key", "low", "fp").distinct(), "index")


def compared(rooted: DataFrame, sketches: DataFrame, keep: Keep, forest: bool, chunk: int = CHUNK) -> DataFrame:
    """(a, b): pairs of one key (key, fp, root) in different components whose sketches allow similarity.

    All of them, or only as many as connect the same components of each group of a task.

    Members of a key are compared in a task; a key of more than ``chunk`` is dealt to all pairs of its chunks.
    """
    sizes = rooted.groupBy(F.col("key").alias("_key")).agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count("*") / chunk).cast("int").alias("parts"))
    apart = rooted.join(sizes.where(F.col("low") < F.col("high")), rooted["key"] == F.col("_key")).join(sketches, "fp")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda other: F.struct(F.xxhash64("key", F.least(own, other), F.greatest(own, other)).alias("group"), F.when(other == own, -1).otherwise(own).alias("part")),
    )
    dealt = apart.select(F.explode(pairs).alias("g"), "fp", "root", "n", "sketch").select("g.group", "g.part", "fp", "root", "n", "sketch")
    dealt = dealt.repartition("group").sortWithinPartitions("group")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in (*batches, None):
            if batch is not None:
                new = [batch.column(i).to_numpy() for i in range(5)] + [_sketches(batch.column(5))]
                held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            if held is None or not len(held[0]):
                continue
            # the last group may go on in the next batch
            cut = len(held[0]) if batch is None else int(np.searchsorted(held[0], held[0][-1]))
            if cut:
                for a, b in met(*(x[:cut] for x in held), forest):
                    low, high = np.minimum(a, b), np.maximum(a, b)
                    yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], names=["a", "b"])
                held = [x[cut:] for x in held]

    with working(rooted.sparkSession) as brief:
        return keep(mapped(dealt, run, "a bigint, b bigint", "met", rows=4096, keep=brief).distinct(), "close")


def met(
    group: np.ndarray, part: np.ndarray, fp: np.ndarray, root: np.ndarray, n: np.ndarray, sketch: np.ndarray, forest: bool
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The close pairs of equal group and different root; of a pair of chunks, those across.  Rows are sorted by group.

    With ``forest`` a pair joins the components of its group, and pairs within a component are left out from then on.
    """
    alive, step = np.arange(len(group)), 1
    n = n.astype(np.int64)
    order = np.lexsort((root, group))
    new = np.concatenate([[True], (group[order][1:] != group[order][:-1]) | (root[order][1:] != root[order][:-1])])
    label = np.empty(len(group), np.int64)  # the component of each row within its group
    label[order] = np.cumsum(new) - 1
    while True:
        alive = alive[alive + step < len(group)]
        alive = alive[group[alive] == group[alive + step]]
        if not len(alive):
            return
        left = alive[(label[alive] != label[alive + step]) & ((part[alive] < 0) | (part[alive] != part[alive + step]))]
        left = left[fits(n[left], n[left + step], sketch[left], sketch[left + step])]
        if forest and len(left):
            low, high = np.minimum(label[left], label[left + step]), np.maximum(label[left], label[left + step])
            ends, first = np.unique(np.stack([low, high]), axis=1, return_index=True)
            left = left[first]
            label = united(label, *ends)
        if len(left):
            yield fp[left], fp[left + step]
        step += 1


def united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The labels after the labels a and b are made one, pair by pair."""
    to = np.arange(int(label.max()) + 1)
    while True:
        before = to.copy()
        low = np.minimum(to[a], to[b])
        np.minimum.at(to, to[a], low)
        np.minimum.at(to, to[b], low)
        np.minimum.at(to, a, low)
        np.minimum.at(to, b, low)
        to = to[to]
        if np.array_equal(to, before):
            return to[label]


def marked(found: DataFrame) -> DataFrame:
    """(a, b): pairs of sets that SimHash links: the first sets of linked fingerprints, and sets of one fingerprint with its first.

    Texts of one set may repeat its shingles differently and so have several fingerprints; the smallest is the set's.
    """
    sets = found.groupBy("fp").agg(F.min("mark").alias("mark"))
    first = saved(sets.groupBy("mark").agg(F.min("fp").alias("first")), "marks")
    same = sets.join(first, "mark").where(F.col("fp") != F.col("first")).select(F.col("first").alias("a"), F.col("fp").alias("b"))
    near = simhash.links(first.select(F.col("mark").alias("fp")))
    for side in ("a", "b"):
        near = near.join(first.select(F.col("mark").alias(side), F.col("first").alias(f"first_{side}")), side)
    return same.unionByName(near.select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b")))


def links(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b): links that connect the same sets as all similar pairs do."""
    with working(docs.sparkSession) as keep:
        sketches = keep(found.groupBy("fp").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "sketches")
        index = shared(docs, keep)
        with working(docs.sparkSession) as brief:
            tried = index.where(F.col("low") < F.col("fp")).select(F.col("low").alias("a"), F.col("fp").alias("b"))
            tried = tried.unionByName(marked(found)).distinct()
            edges = alike(close(tried, sketches, brief), docs, found, brief)
        for forest in (True, False):
            tree = simhash.components(edges)
            with working(docs.sparkSession) as brief:
                rooted = index.join(tree, index["fp"] == tree["node"], "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))
                more = alike(compared(brief(rooted, "rooted"), sketches, brief, forest), docs, found, brief)
            edges = edges.unionByName(more)
    return edges


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_hash``, ``fp`` and ``component_id`` of every row."""
    found = prints(docs)
    distinct = saved(found.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    classes = simhash.named(distinct, simhash.components(links(docs, found)))
    return found.join(classes, "fp").select("doc_id", "text_hash", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, the one with the smallest id (of equal ids, the smallest text hash), columns as given."""
    return simhash.first_rows(docs, near_duplicates(docs))
