"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes of a text.

Both encoders' tokens are turned into sorted lists of byte offsets where tokens end.  The shorter list drives a galloping
intersection: each of its offsets starts at the longer list's place of the same share, doubles its step towards the
offset and ends with a binary search in the last step.  All searches of a stretch of texts advance together.  An offset
found in both lists is a common end: the common ends' indices slice both lists into groups.  The ranks of neighbouring
offsets differ by the number of longer-list tokens that a shorter-list token overlaps: these ranges are the links.

How often two ids are linked is counted over the whole corpus.  Tasks add up pairs before they are shuffled; the
counts are written, one row a pair.  A text's links are weighed by them in two ways, exact together: the ``LISTED`` most
frequent pairs go to every task, the other pairs of a text are joined with the counts by shuffle.  Frequent pairs thus
never make a hot key, and what is sent to the tasks is bounded by ``LISTED``.

A null or empty text, and a text that one of the vocabularies does not give back byte for byte, has no tokens: zeros and
an empty string.  Repeated rows and null ids are rows like any other, and repeats count in the corpus; extra columns pass
through, except that ``text`` is left out and columns named as the results are replaced.  An empty table stays empty.
Texts are encoded whole; memory is bounded by the longest text or ``STRETCH`` bytes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sofralytics.llm.common import arrow_rows, fresh, saved

LISTED, STRETCH, HELD = 200_000, 1 << 20, 1 << 21  # pairs sent to tasks; bytes of text in one go; pairs a task holds
# Fixed value: how the byte-level vocabulary cuts a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where printable, else the next from 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteLevel:
    """A byte-level BPE vocabulary from a tokenizer file whose ids are in the order of its merges."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        if held["normalizer"] or held["pre_tokenizer"]["type"] != "ByteLevel" or held["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path}: not a plain byte-level vocabulary")
        letters, vocabulary = byte_letters(), held["model"]["vocab"]
        special = {t["id"] for t in held["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): rank for token, rank in vocabulary.items() if rank not in special}
        made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in held["model"]["merges"]]
        if made != sorted(made):
            raise ValueError(f"{path}: ids are not in the order of the merges")
        self.tokens = [b""] * (max([*ranks.values(), *special]) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self._bpe = tiktoken.Encoding("byte_level", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """The ids of a blank and each text."""
        return [self._bpe.encode_to_numpy(" " + t, disallowed_special=()).astype(np.int64) for t in texts]


class Pieces:
    """A sentencepiece vocabulary that puts a blank before each text."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self._model.get_piece_size()
        self.tokens = [
            bytes([int(self._model.id_to_piece(i)[3:5], 16)]) if self._model.is_byte(i) else self._model.id_to_piece(i).replace("▁", " ").encode() for i in range(size)
        ]

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        return [np.array(ids, dtype=np.int64) for ids in self._model.encode(list(texts), num_threads=1)]


@lru_cache(maxsize=8)
def byte_level(path: str) -> ByteLevel:
    return ByteLevel(path)


@lru_cache(maxsize=8)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def gallop(driver: np.ndarray, longer: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each driver value the smallest index in [first, last] whose entry of ``longer`` is not smaller.

    ``longer`` is sorted and its entry at ``last`` is not smaller than the value; searches start at ``at``.
    """
    low, high = first - 1, last.copy()  # below low everything is smaller, from high on nothing
    smaller = longer[at] < driver
    low[smaller], high[~smaller] = at[smaller], at[~smaller]
    for rows, sign in ((np.flatnonzero(smaller), 1), (np.flatnonzero(~smaller), -1)):
        step = 1
        while len(rows):
            probe = np.clip(at[rows] + sign * step, first[rows], last[rows])
            below = longer[probe] < driver[rows]
            low[rows[below]], high[rows[~below]] = probe[below], probe[~below]
            passed = (~below) if sign > 0 else (below | (probe == first[rows]))
            rows, step = rows[~passed], step * 2
    rows = np.flatnonzero(high - low > 1)
    while len(rows):
        middle = (low[rows] + high[rows]) >> 1
        below = longer[middle] < driver[rows]
        low[rows[below]], high[rows[~below]] = middle[below], middle[~below]
        rows = rows[high[rows] - low[rows] > 1]
    return high


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def overlaps(short: np.ndarray, short_n: np.ndarray, long: np.ndarray, long_n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(common, first, last) for each token of the shorter lists: whether its end is common, the longer tokens it overlaps.

    The lists hold the ends of one text after another, offset so that they ascend; ``short_n`` and ``long_n`` are the numbers
    of tokens of each text, above zero.
    """
    short_start, long_start = _starts(short_n), _starts(long_n)
    text = np.repeat(np.arange(len(short_n)), short_n)
    within = np.arange(len(short)) - short_start[text]
    share = long_start[text] + within * long_n[text] // short_n[text]
    rank = gallop(short, long, share, long_start[text], long_start[text + 1] - 1)
    common = long[rank] == short
    first = np.empty_like(rank)
    first[1:] = rank[:-1] + common[:-1]
    first[short_start[:-1]] = long_start[:-1]
    return common, first, rank


def _expanded(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (k, j) with first[k] <= j <= last[k]."""
    counts = last - first + 1
    k = np.repeat(np.arange(len(first)), counts)
    return k, np.arange(len(k)) - _starts(counts)[k] + first[k]


class Aligner:
    """The alignment of texts; kept by a worker."""

    def __init__(self, a, b):
        self.a, self.b = a, b
        self.sizes = [np.array([len(t) for t in v.tokens], dtype=np.int64) for v in (a, b)]
        self.n_a, self.n_b = len(a.tokens), len(b.tokens)
        written = [f"{i}{sep}".encode() for n, seps in ((self.n_a, ",|"), (self.n_b, ",;")) for sep in seps for i in range(n)]
        self.written = np.array([*written, *[str(i).encode() for i in range(self.n_b)]], dtype=object)

    def _kept(self, texts: Sequence[str | None]) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
        """The rows that both vocabularies give back, and their ids."""
        rows = [i for i, t in enumerate(texts) if t]
        asked = [texts[i] for i in rows]
        kept, ids_a, ids_b = [], [], []
        for i, text, x, y in zip(rows, asked, self.a.encode(asked), self.b.encode(asked), strict=True):
            want = b" " + text.encode()
            if all(b"".join(map(v.tokens.__getitem__, ids.tolist())) == want for v, ids in ((self.a, x), (self.b, y))):
                kept.append(i)
                ids_a.append(x)
                ids_b.append(y)
        return kept, ids_a, ids_b

    def align(self, texts: Sequence[str | None]) -> dict[str, object]:
        """Results of each text; ``pairs`` and ``times`` are its distinct linked id pairs (a * n_b + b) and their links."""
        count = len(texts)
        out = {name: np.zeros(count, dtype=np.int64) for name in ("n_a", "n_b", "n_groups", "n_links")}
        groups, sizes = [b""] * count, np.zeros(count, dtype=np.int64)
        kept, ids_a, ids_b = self._kept(texts)
        if not kept:
            return out | {"groups": groups, "pairs": np.empty(0, np.int64), "times": np.empty(0, np.int64), "sizes": sizes}
        rows = np.array(kept)
        n = [np.array([len(x) for x in ids]) for ids in (ids_a, ids_b)]
        a, b = np.concatenate(ids_a), np.concatenate(ids_b)
        ends = [np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])]  # texts have the same bytes on both sides
        turned = n[0] > n[1]
        link_a, link_b, common = [], [], np.zeros(len(a), dtype=bool)
        for swap in (False, True):  # texts whose a list is the shorter, then the others
            texts_here = np.flatnonzero(turned == swap)
            if not len(texts_here):
                continue
            mine = [np.flatnonzero(np.isin(np.repeat(np.arange(len(rows)), c), texts_here)) if len(texts_here) < len(rows) else np.arange(c.sum()) for c in n]
            short, long = (1, 0) if swap else (0, 1)
            shared, first, last = overlaps(ends[short][mine[short]], n[short][texts_here], ends[long][mine[long]], n[long][texts_here])
            k, j = _expanded(first, last)
            k, j = mine[short][k], mine[long][j]
            link_a.append(j if swap else k)
            link_b.append(k if swap else j)
            common[mine[long][last[shared]] if swap else mine[short][shared]] = True
        link_a, link_b = np.concatenate(link_a), np.concatenate(link_b)

        text_a = np.repeat(np.arange(len(rows)), n[0])
        pair = a[link_a] * self.n_b + b[link_b]
        order = np.lexsort((pair, text_a[link_a])) if self.n_a * self.n_b * len(rows) >= 1 << 62 else np.argsort(text_a[link_a] * (self.n_a * self.n_b) + pair)
        pair, text_of = pair[order], text_a[link_a][order]
        new = np.concatenate([[True], (pair[1:] != pair[:-1]) | (text_of[1:] != text_of[:-1])])
        at = np.flatnonzero(new)
        out["n_a"][rows], out["n_b"][rows] = n[0], n[1]
        out["n_groups"][rows] = np.bincount(text_a, common, len(rows)).astype(np.int64)
        out["n_links"][rows] = np.bincount(text_of, minlength=len(rows))
        sizes[rows] = np.bincount(text_of[at], minlength=len(rows))
        for row, held in zip(kept, self._written(a, b, ends, common, n), strict=True):
            groups[row] = held
        return out | {"groups": groups, "pairs": pair[at], "times": np.diff(np.append(at, len(pair))), "sizes": sizes}

    def _written(self, a: np.ndarray, b: np.ndarray, ends: list[np.ndarray], common: np.ndarray, n: list[np.ndarray]) -> Iterator[bytes]:
        """The groups of each text in writing: ids of a, a bar, ids of b; groups are parted by semicolons."""
        last_a = np.flatnonzero(common)
        last_b = np.searchsorted(ends[1], ends[0][last_a])  # common ends only: a plain look-up
        closes = np.zeros(len(b), dtype=bool)
        closes[last_b] = True
        text_ends = np.zeros(len(b), dtype=bool)
        text_ends[np.cumsum(n[1]) - 1] = True
        group_a = np.cumsum(common) - common
        group_b = np.cumsum(closes) - closes
        codes = np.empty(len(a) + len(b), dtype=np.int64)
        codes[np.arange(len(a)) + np.concatenate([[0], last_b + 1])[group_a]] = a + self.n_a * common
        codes[np.arange(len(b)) + (last_a + 1)[group_b]] = b + 2 * self.n_a + self.n_b * (closes.astype(np.int64) + text_ends)
        start = 0
        for size in (n[0] + n[1]).tolist():
            yield b"".join(self.written[codes[start : start + size]].tolist())
            start += size


RESULTS = T.StructType(
    [T.StructField(name, T.LongType()) for name in ("n_a", "n_b", "n_groups", "n_links")]
    + [T.StructField("groups", T.BinaryType())]
    + [T.StructField(name, T.ArrayType(T.LongType())) for name in ("pairs", "times", "corpus_pairs", "corpus_times")]
)
_WEIGHED = ("n_best", "count_sum")


def stretches(sizes: Sequence[int], bound: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold ``bound`` bytes together, or one row."""
    start = held = 0
    for i, size in enumerate(sizes):
        if held + size > bound and i > start:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def _added(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, where = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(where, np.concatenate(times), len(found)).astype(np.int64)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(_starts(sizes), pa.int32()), pa.array(values, pa.int64()))


def aligned(rows: DataFrame, text: str, a_path: str, b_path: str) -> DataFrame:
    """The rows without their text, with ``RESULTS``; rows of nulls with ``corpus_*`` hold the tasks' sums over their texts."""
    own = [c for c in rows.columns if c != text]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.select(*own).schema] + RESULTS.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(byte_level(a_path), pieces(b_path))
        keys, times, held, kinds = [], [], 0, None

        def sums() -> pa.RecordBatch:
            columns = [pa.nulls(1, k) for k in kinds] + [pa.nulls(1, pa.int64())] * 4 + [pa.nulls(1, pa.binary())] + [pa.nulls(1, pa.list_(pa.int64()))] * 2
            columns += [_lists(x, np.array([len(x)])) for x in (keys[0], times[0])]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            kinds = [batch.column(i).type for i in range(1, batch.num_columns)]
            texts = batch.column(0).to_pylist()
            for start, stop in stretches([len(t or "") for t in texts], STRETCH):
                found = aligner.align(texts[start:stop])
                part = batch.slice(start, stop - start)
                columns = [part.column(i) for i in range(1, batch.num_columns)]
                columns += [pa.array(found[name]) for name in ("n_a", "n_b", "n_groups", "n_links")] + [pa.array(found["groups"], pa.binary())]
                columns += [_lists(found[x], found["sizes"]) for x in ("pairs", "times")] + [pa.nulls(stop - start, pa.list_(pa.int64()))] * 2
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                keys.append(found["pairs"])
                times.append(found["times"])
                held += len(found["pairs"])
                if held > HELD:
                    keys, times = ([x] for x in _added(keys, times))
                    held = len(keys[0])
                    if held > HELD // 2:
                        yield sums()
                        keys, times, held = [], [], 0
        if held:
            keys, times = ([x] for x in _added(keys, times))
            yield sums()

    return rows.select(text, *own).mapInArrow(run, schema)


def pair_counts(found: DataFrame, n_b: int) -> DataFrame:
    """(pair, links, best) of the whole corpus; ``best`` where no pair of the same b id has more links."""
    counted = found.select(F.explode(F.arrays_zip("corpus_pairs", "corpus_times")).alias("p")).groupBy(F.col("p.corpus_pairs").alias("pair")).agg(F.sum("p.corpus_times").alias("links"))
    counted = saved(counted, "pairs").withColumn("b", F.col("pair") % n_b)
    most = counted.groupBy("b").agg(F.max("links").alias("most"))
    best = counted.join(F.broadcast(most), "b")  # one row an id of the vocabulary
    return saved(best.select("pair", "links", (F.col("links") == F.col("most")).alias("best")), "pair_counts")


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", groups: Column | None = None, listed: int = LISTED) -> DataFrame:
    """The rows without their text, with ``n_a, n_b, n_groups, n_links, n_best, count_sum`` and ``groups``.

    ``groups`` is an expression of what is kept of the written groups (the binary column of that name), by default all.
    """
    row, known, best, rest, rest_times = (fresh(docs, f"_{n}") for n in ("row", "known", "known_best", "rest", "rest_times"))
    names = {*RESULTS.names, *_WEIGHED}
    own = [c for c in docs.columns if c != text and c not in names]
    spark = docs.sparkSession
    shown = (F.col("groups") if groups is None else groups).alias("groups")
    with arrow_rows(spark, 256):
        found = aligned(docs.select(text, *own).withColumn(row, F.monotonically_increasing_id()), text, a_path, b_path)
        found = saved(found.withColumn("groups", shown), "aligned")
    counts = pair_counts(found, len(pieces(b_path).tokens))
    top = counts.orderBy(F.desc("links"), "pair").limit(listed).toPandas().sort_values("pair")
    keys, links, flags = top["pair"].to_numpy(np.int64), top["links"].to_numpy(np.int64), top["best"].to_numpy(bool)

    held = [*own, row, *[n for n in RESULTS.names if not n.startswith("corpus_")]]
    kept = [c for c in held if c not in ("pairs", "times")]
    schema = T.StructType(found.select(*kept).schema.fields + [T.StructField(n, T.LongType()) for n in (known, best)] + [T.StructField(n, T.ArrayType(T.LongType())) for n in (rest, rest_times)])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, times = (batch.column(name).flatten().to_numpy() for name in ("pairs", "times"))
            sizes = np.diff(batch.column("pairs").offsets.to_numpy())
            text_of = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
            hit = keys[at] == pair if len(keys) else np.zeros(len(pair), dtype=bool)
            sums = [np.zeros(len(sizes), dtype=np.int64) for _ in range(2)]
            for total, value in zip(sums, (links[at[hit]], flags[at[hit]].astype(np.int64)), strict=True):
                np.add.at(total, text_of[hit], times[hit] * value)
            left = np.bincount(text_of[~hit], minlength=len(sizes))
            columns = [batch.column(c) for c in kept] + [pa.array(s) for s in sums] + [_lists(x[~hit], left) for x in (pair, times)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    with arrow_rows(spark, 256):
        weighed = saved(found.where(F.col(row).isNotNull()).select(*held).mapInArrow(weigh, schema), "weighed")
    others = weighed.where(F.size(rest) > 0).select(row, F.explode(F.arrays_zip(rest, rest_times)).alias("p"))
    others = others.select(F.col(row).alias("of"), F.col("p")[rest].alias("pair"), F.col("p")[rest_times].alias("times")).join(counts, "pair")
    others = others.groupBy("of").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("times")).alias("count_sum"))
    added = weighed.join(others, weighed[row] == others["of"], "left")
    totals = [(F.col(x) + F.coalesce(F.col(y), F.lit(0))).alias(y) for x, y in ((best, "n_best"), (known, "count_sum"))]
    return added.select(*own, "n_a", "n_b", "n_groups", "n_links", *totals, "groups")
