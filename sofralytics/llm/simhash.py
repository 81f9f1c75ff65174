"""SimHash near-duplicates by deletion-variant signatures, and the components their links make.

A fingerprint has 64 bits.  Cut into (d + 2) // 2 segments, two fingerprints that differ in at most d bits have a segment
in which they differ in at most one bit.  Each segment is therefore indexed as it is and with each of its bits left
out: equal entries are the candidates, and the whole fingerprints verify them.  Under the entry as it is, all members
are compared; under an entry without a bit, only members that have this bit against those that don't, so a pair meets
once per segment at most.

Copies are one fingerprint.  An entry with many fingerprints (a large group of near copies) is cut into chunks of at
most ``CHUNK`` by hash, and each pair of chunks is a group of its own; every group reports a spanning forest of the
links it finds, at most one link for each row, not all pairs.  Which fingerprints are connected is thus kept exactly.

Null texts and texts without a word have fingerprint zero and are linked like any other; repeated rows and ties share a
component; null ids never name a component unless all its ids are null; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sofralytics.llm.common import fresh, mapped, saved, word_blocks

BITS, MAX_BITS, CHUNK = 64, 4, 1024


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """The bits set in over half of the XXH64 values of the text's shingles of ``width`` words."""
    counts, total, tail = np.zeros(BITS, dtype=np.int64), 0, []
    for block in word_blocks(text.lower()):
        held = tail + block
        if len(held) >= width:
            total += _count(held, width, seed, counts)
            tail = held[len(held) - width + 1 :]
        else:
            tail = held
    if total == 0 and tail:
        total = _count(tail, len(tail), seed, counts)
    return int(sum(1 << i for i in range(BITS) if 2 * counts[i] > total))


def _count(held: list[bytes], width: int, seed: int, counts: np.ndarray) -> int:
    """Add the bits of all shingles of these words; returns how many shingles there are."""
    joined = b" ".join(held)
    ends = list(accumulate(len(w) + 1 for w in held))
    starts = [0, *ends[: len(held) - width]]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s : e - 1], seed) for s, e in zip(starts, ends[width - 1 :], strict=True)], dtype=np.uint64)
    for part in np.array_split(hashes, len(hashes) // 65_536 + 1):
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return len(hashes)


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """``doc_id``, ``text_hash`` (of the whole text, null as empty) and ``fp`` (signed 64 bits) of every row."""
    kept = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, width) for t in batch.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values)], names=["doc_id", "text_hash", "fp"])

    return mapped(kept, run, f"doc_id {kind}, text_hash bigint, fp bigint", "fingerprints")


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of the segments."""
    n = (max_bits + 2) // 2
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def variants(fp: Column, max_bits: int) -> Column:
    """Index entries of a fingerprint: array<struct<key, side>>; side is the bit left out, 2 if there is none.

    A key is the segment's number, the position of the bit left out plus one, and the segment's other bits.
    """
    out = []
    for s, (first, size) in enumerate(segments(max_bits)):
        value = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << size) - 1).cast("bigint"))
        head = s << 56
        out.append(F.struct((value + F.lit(head).cast("bigint")).alias("key"), F.lit(2).alias("side")))
        for bit in range(size):
            mask = F.lit(((1 << size) - 1) & ~(1 << bit)).cast("bigint")
            key = value.bitwiseAND(mask) + F.lit(head + ((bit + 1) << 48)).cast("bigint")
            side = F.shiftright(value, bit).bitwiseAND(F.lit(1).cast("bigint")).cast("int")
            out.append(F.struct(key.alias("key"), side.alias("side")))
    return F.array(*out)


def candidates(distinct: DataFrame, max_bits: int = MAX_BITS, chunk: int = CHUNK) -> DataFrame:
    """(group, fp, side): rows of one group are to be compared; entries over ``chunk`` are dealt to pairs of chunks."""
    index = distinct.select("fp", F.explode(variants(F.col("fp"), max_bits)).alias("v")).select("fp", "v.key", "v.side")
    large = saved(index.groupBy("key").count().where(F.col("count") > chunk), "large")
    large = large.select(F.col("key").alias("_key"), F.ceil(F.col("count") / chunk).cast("int").alias("_parts"))
    dealt = index.join(large, index["key"] == large["_key"], "left")
    own = F.pmod(F.xxhash64("fp"), F.col("_parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda other: F.xxhash64("key", F.least(own, other), F.greatest(own, other)))
    groups = F.when(F.col("_parts").isNull(), F.array("key")).otherwise(pairs)
    return dealt.select(F.explode(groups).alias("group"), "fp", "side")


def forest(groups: np.ndarray, values: np.ndarray, sides: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between rows of equal group; the rows are sorted by group."""
    n, step = len(groups), 1
    left, right = [], []
    alive = np.arange(n)
    while True:
        alive = alive[alive + step < n]
        alive = alive[groups[alive] == groups[alive + step]]
        if not len(alive):
            break
        other = alive + step
        fits = (np.bitwise_count(values[alive] ^ values[other]) <= max_bits) & ((sides[alive] == 2) | (sides[alive] != sides[other]))
        left.append(alive[fits])
        right.append(other[fits])
        step += 1
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    label = np.arange(n)
    while True:  # the smallest row of each connected set
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    rows = np.flatnonzero(label != np.arange(n))
    return rows, label[rows]


def links(distinct: DataFrame, max_bits: int = MAX_BITS, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links that connect the same fingerprints as all pairs within ``max_bits`` do."""
    rows = candidates(distinct, max_bits, chunk)
    rows = rows.repartition(F.col("group")).sortWithinPartitions("group")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int32))
        for batch in (*batches, None):
            if batch is not None:
                new = (batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy())
                held = tuple(np.concatenate(x) for x in zip(held, new, strict=True))
            # the last group may go on in the next batch
            cut = len(held[0]) if batch is None or not len(held[0]) else int(np.searchsorted(held[0], held[0][-1]))
            if cut:
                a, b = forest(*(x[:cut] for x in held), max_bits)
                v = held[1].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(v[a]), pa.array(v[b])], names=["a", "b"])
                held = tuple(x[cut:] for x in held)

    found = mapped(rows, run, "a bigint, b bigint", "links", rows=65_536)
    return found.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge: alternating large-star and small-star steps until nothing changes.

    Each step links nodes to the smallest neighbour they know; each is a partial aggregation and a join, and its rows
    are written, so that no step is computed twice.
    """
    now = saved(edges.select("a", "b"), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("low").alias("a"), "b")
        large = large.where(F.col("a") != F.col("b")).distinct()  # a < b: b hangs below a
        floor = large.groupBy("b").agg(F.min("a").alias("low"))
        small = large.join(floor, "b").select(F.explode(F.array(F.struct(F.col("low").alias("a"), F.col("b").alias("b")), F.struct(F.col("low").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        now = saved(small.where(F.col("a") != F.col("b")).distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == mark or not state[0]:
            break
        mark = state
    roots = now.groupBy("b").agg(F.min("a").alias("root")).withColumnRenamed("b", "node")
    return roots.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def classes(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, component_id) of every fingerprint: the smallest doc_id that links reach."""
    distinct = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    return named(distinct, components(links(distinct, max_bits)))


def named(distinct: DataFrame, tree: DataFrame) -> DataFrame:
    """(fp, component_id) of distinct fingerprints (fp, first_id) and their roots."""
    rooted = distinct.join(tree, distinct["fp"] == tree["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(smallest, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, width: int = 4) -> DataFrame:
    """``doc_id``, ``text_hash``, ``fp`` and ``component_id`` of every row."""
    prints = fingerprints(docs, width)
    return prints.join(classes(prints, max_bits), "fp").select("doc_id", "text_hash", "fp", "component_id")


def first_rows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The first row of each component of ``found``.

    The rows to keep are found among ids and hashes only; texts are then met by a semi-join on both.  Rows that are the
    same in both are numbered, and one stays.
    """
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    first = saved(found.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("fp")).agg(F.min(order).alias("first")).select("first.doc_id", "first.text_hash"), "kept")
    key, copy = fresh(docs, "_key"), fresh(docs, "_copy")
    first = first.distinct().select(F.struct("doc_id", "text_hash").alias(key))
    text_hash = F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")
    kept = docs.withColumn(key, F.struct("doc_id", text_hash)).join(first, key, "left_semi")
    same = Window.partitionBy(key).orderBy(key)  # dealt as the join has dealt them
    return kept.withColumn(copy, F.row_number().over(same)).where(F.col(copy) == 1).select(*docs.columns)


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
