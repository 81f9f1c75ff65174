"""Katz backoff language model of order two, and the log10 probability of every text.

p(w | v) = d(c) c(v, w) / c(v) where the pair was seen in training, once is enough, else a(v) p(w).  d is the
Good-Turing discount of counts up to ``TOP``; a(v) gives what the discounted pairs of v leave to the words not seen after
v, so every distribution sums to one over the known words, the end and one unknown word.  p(w) is the Good-Turing
discounted word distribution; its missing mass is the unknown word's.  Where all of a history's mass would be taken, half
a count is kept back for backoff.

Counting and look-up work on packed keys, since a corpus has about as many distinct pairs as words: a task turns a
stretch of documents into 64-bit word hashes once and writes them, as its distinct words and each token's place among
them.  Every later step reads these rows.  A stretch sends each shard of the key space its distinct keys of words and
pairs, six bytes each, and the shard answers with a byte or more of count for each key, in the order of the keys; so no
pair is a row of its own, and no step sorts or joins pairs one by one.  Shards are ranges of uniformly hashed *keys*, so a
frequent word or pair is one key among many and no shard is hot; their number grows with the corpus.

Training: shards count the keys and name one stretch that has it the owner of each pair; stretches add up, for every
history, the discounted counts and the seconds' probabilities of the pairs they own; shards add these up to a(v).  The
model is a row a shard of words (count, share, backoff) and one of pairs (count).  Scoring asks the shards for these
values and adds up the texts' tokens where the stretch is:

    log10 p(w | v) = log10(d(c) c(v, w)) + log10 share(v)   if the pair was seen, else   log10 a(v) + log10 p(w)

Every step's rows are written; those that only later steps need are dropped after it.  Null texts count as empty (they
are one end); repeated rows are scored once each and null ids as empty ids; an empty training set leaves only the unknown
word, with probability one; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import ExitStack, contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sofralytics.llm.common import arrow_rows, crc_mod, saved, scratch, setting, word_blocks

TOP, SMOOTH = 5, 0.1
STRETCH_TOKENS, STRETCH_DOCS, SHARD_TOKENS = 1_000_000, 60_000, 1_500_000
PASSES = 2  # of look-ups, each over a part of the shards, so that no more than a part is shuffled at a time
STATE_ROWS = 8  # stretches of some megabytes in an Arrow batch
END, START = xxhash.xxh64_intdigest(b" "), xxhash.xxh64_intdigest(b"  ")  # no word has a blank
_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
FOLDS = 10


def held_out(doc_id: Column) -> Column:
    return crc_mod(doc_id, FOLDS) == 0


def tokens(text: bytes) -> np.ndarray:
    """Hashes of the words, lower-cased, and of the end."""
    digest = xxhash.xxh64_intdigest
    parts = [np.array([digest(w) for w in block], dtype=np.uint64) for block in word_blocks(text.lower())]
    return np.concatenate([*parts, np.array([END], dtype=np.uint64)])


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = (first ^ (first >> np.uint64(29))) * _ONE + second
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _TWO
    return mixed ^ (mixed >> np.uint64(29))


def stretches(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """Runs of documents of about ``STRETCH_TOKENS`` tokens: their rows, all tokens, tokens of each document."""
    rows, found, total, docs = [], [], 0, 0
    for batch in batches:
        rows.append(batch.select([i for i in range(batch.num_columns) if i != text]))
        for t in batch.column(text).to_pylist():
            found.append(tokens(t))
            total += len(found[-1])
        docs += batch.num_rows
        if total >= STRETCH_TOKENS or docs >= STRETCH_DOCS:
            yield rows, np.concatenate(found), np.array([len(f) for f in found])
            rows, found, total, docs = [], [], 0, 0
    if found:
        yield rows, np.concatenate(found), np.array([len(f) for f in found])


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Equal ranges of the keys' upper 32 bits."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


def parts_of(shard: np.ndarray) -> list[tuple[int, int, int]]:
    """(shard, start, end) of the runs of sorted shard numbers; shards that have no key cost nothing."""
    names, starts = np.unique(shard, return_index=True)
    ends = np.append(starts, len(shard))[1:]
    return list(zip(names.tolist(), starts.tolist(), ends.tolist(), strict=True))


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys as differences of as many bytes as the largest needs, after that number and the first key."""
    steps = np.diff(keys)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + keys[:1].tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    steps = np.frombuffer(data, dtype=np.uint8, offset=9).reshape(-1, width)
    wide = np.zeros((len(steps) + 1, 8), dtype=np.uint8)
    wide[1:, :width] = steps
    out = wide.reshape(-1).view(np.uint64)
    out[0] = np.frombuffer(data, dtype=np.uint64, count=1, offset=1)[0]
    return np.cumsum(out, dtype=np.uint64)


def inputs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def small_counts(c: np.ndarray) -> bytes:
    """How many, then a byte for each count, then those of 255 and more in full."""
    return np.int64(len(c)).tobytes() + np.minimum(c, 255).astype(np.uint8).tobytes() + c[c >= 255].astype(np.int64).tobytes()


def counts_of(data: bytes) -> np.ndarray:
    size = int(np.frombuffer(data, dtype=np.int64, count=1)[0])
    c = np.frombuffer(data, dtype=np.uint8, count=size, offset=8).astype(np.int64)
    c[c == 255] = np.frombuffer(data, dtype=np.int64, offset=8 + size)
    return c


def planes(values: np.ndarray, width: int) -> bytes:
    """Numbers of ``width`` bytes, all the lowest bytes first; the highest compress well."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T).tobytes()


def from_planes(data: bytes, width: int) -> np.ndarray:
    wide = np.zeros((len(data) // width, 4), dtype=np.uint8)
    wide[:, :width] = np.frombuffer(data, dtype=np.uint8).reshape(width, -1).T
    return wide.reshape(-1).view("<u4").astype(np.int64)


_STATE = "stretch bigint, tokens bigint, doc_id array<string>, held_out array<boolean>, sizes binary, words binary, width int, places binary"


def state_rows(docs: DataFrame) -> DataFrame:
    """A row a stretch of the rows of ``inputs``: ids, tokens of each document, distinct words, each token's place among these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for i, (rows, found, sizes) in enumerate(stretches(batches, 2)):
            words, at = np.unique(np.append(found, np.uint64(START)), return_inverse=True)
            width = max(1, (len(words).bit_length() + 7) // 8)
            ids, held = ([x for batch in rows for x in batch.column(k).to_pylist()] for k in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(task << 32) + i], pa.int64()), pa.array([len(found)], pa.int64()), pa.array([ids], pa.list_(pa.string())), pa.array([held], pa.list_(pa.bool_())),
                    pa.array([sizes.astype(np.int64).tobytes()], pa.binary()), pa.array([packed(words)], pa.binary()), pa.array([width], pa.int32()), pa.array([planes(at[:-1], width)], pa.binary()),
                ],
                names=[c.split()[0] for c in _STATE.split(", ")],
            )

    return docs.mapInArrow(run, _STATE)


class Stretch:
    """A row of ``state_rows``: sorted words, each token's word and the word before it (places among the words), sorted
    distinct pairs, each token's pair, and a token that each pair stands at."""

    def __init__(self, row: dict):
        self.id, self.doc_id, self.held_out = row["stretch"], row["doc_id"], row["held_out"]
        self.sizes = np.frombuffer(row["sizes"], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.words, self.at = unpacked(row["words"]), from_planes(row["places"], row["width"])
        self.before = np.empty_like(self.at)
        self.before[1:] = self.at[:-1]
        self.before[self.starts] = np.searchsorted(self.words, np.uint64(START))
        keys = pair_keys(self.words[self.before], self.words[self.at])
        self.pairs, self.token, self.pair = np.unique(keys, return_index=True, return_inverse=True)


_SENT = "shard int, stretch bigint, kind int, keys binary, n binary"
WORDS, PAIRS = 0, 1


def sent_keys(state: DataFrame, shards: int, kinds: tuple[int, ...] = (WORDS, PAIRS), part: int | None = None, numbers: bool = True) -> DataFrame:
    """(shard, stretch, kind, keys, n): each stretch's words and pairs of a shard and, with numbers, how often it has
    them; with a part, the keys of that part of the shards only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                stretch, rows = Stretch(row), []
                for kind in kinds:
                    keys, used = (stretch.words, stretch.at) if kind == WORDS else (stretch.pairs, stretch.pair)
                    n = np.bincount(used, minlength=len(keys)) if numbers else None
                    for s, a, b in parts_of(shard_of(keys, shards)):
                        if part is None or s % PASSES == part:
                            rows.append((s, stretch.id, kind, packed(keys[a:b]), None if n is None else small_counts(n[a:b])))
                yield _batch(_SENT, rows)

    return state.select("stretch", F.lit(None).cast("array<string>").alias("doc_id"), F.lit(None).cast("array<boolean>").alias("held_out"), "sizes", "words", "width", "places").mapInArrow(run, _SENT)


_COUNTED = "shard int, stretch bigint, kind int, keys binary, counts binary, mine binary, types array<bigint>, total bigint"


def counted_keys(sent: DataFrame) -> DataFrame:
    """For each shard and kind a row of its keys and their counts, with the number of keys that have each count up to
    ``TOP`` + 1 and the sum; and a row for each stretch: the counts of its keys, and which of these it owns."""

    def merge(group: pa.Table) -> pa.Table:
        out, found = [], group.to_pylist()
        for kind in (WORDS, PAIRS):
            rows = [r for r in found if r["kind"] == kind]
            if not rows:
                continue
            parts = [unpacked(r["keys"]) for r in rows]
            keys, at, back = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
            c = np.bincount(back, weights=np.concatenate([counts_of(r["n"]) for r in rows]), minlength=len(keys)).astype(np.int64)
            own = np.zeros(len(back), bool)
            own[at] = True
            ends = np.cumsum([len(p) for p in parts]).tolist()
            for r, part, end in zip(rows, parts, ends, strict=True):
                a = end - len(part)
                out.append((r["shard"], r["stretch"], kind, None, small_counts(c[back[a:end]]), np.packbits(own[a:end]).tobytes() if kind == PAIRS else None, None, None))
            known = c > 0  # the start is sent with the words, but is none of them
            types = np.bincount(np.minimum(c[known], TOP + 2), minlength=TOP + 3)
            out.append((rows[0]["shard"], None, kind, packed(keys[known]) if known.any() else None, small_counts(c[known]), None, types.tolist(), int(c.sum())))
        return pa.Table.from_batches([_batch(_COUNTED, out)])

    return sent.groupBy("shard").applyInArrow(merge, _COUNTED)


def answers(rows: list[dict], kind: int, column: str, read) -> np.ndarray:
    """The shards' values for a stretch's sorted keys, in the order of the shards and so of the keys."""
    return np.concatenate([read(r[column]) for r in sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["shard"])])


def bits_of(data: bytes, size: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=size).astype(bool)


def doubles(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.float64)


def discounts(counts: dict[int, int]) -> list[float]:
    """Good-Turing discounts of counts 1 .. ``TOP``; half a count is taken off where they are no shares."""
    n = [float(counts.get(r, 0)) for r in range(TOP + 2)]
    out = []
    common = (TOP + 1) * n[TOP + 1] / n[1] if n[1] else 1.0
    for r in range(1, TOP + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else -1.0
        out.append(d if 0 < d < 1 else 1 - 0.5 / r)
    return out


def discounted(c: np.ndarray, d: list[float]) -> np.ndarray:
    return c * np.array([0.0, *d, 1.0])[np.minimum(c, TOP + 1)]


class Model:
    """A row a shard of words (keys, counts, log10 shares, log10 backoffs; the start among them, with no count) and one of
    pairs (keys, counts); the numbers that the distributions need."""

    def __init__(self, words: DataFrame, pairs: DataFrame, n: int, types: int, unknown: float, held: float, d1: list[float], d2: list[float], shards: int):
        self.words, self.pairs, self.n, self.types, self.unknown, self.held, self.d1, self.d2, self.shards = words, pairs, n, types, unknown, held, d1, d2, shards


def word_share(c: np.ndarray, unknown: float, held: float, d1: list[float]) -> np.ndarray:
    """p(w) of known words from their counts; 0 where there is no count."""
    return (1 - unknown) * discounted(c, d1) / (held or 1.0)


@contextmanager
def reading_state(spark: SparkSession) -> Iterator[None]:
    """Few rows of some megabytes at a time, in Parquet's reader as in Arrow's batches."""
    with ExitStack() as stack:
        stack.enter_context(arrow_rows(spark, STATE_ROWS))
        stack.enter_context(setting(spark, "spark.sql.parquet.columnarReaderBatchSize", STATE_ROWS))
        yield


def train(docs: DataFrame) -> Model:
    """Learn from the rows that are not held out."""
    with scratch(docs.sparkSession) as keep:
        return _train(docs, keep)


def _train(docs: DataFrame, keep: Callable[..., DataFrame]) -> Model:
    spark = docs.sparkSession
    with arrow_rows(spark, 256):
        state = keep(state_rows(inputs(docs).where(~F.col("held_out"))), "state", "stretch")
    sizes = state.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.size("doc_id")), F.lit(0)).alias("docs")).first()
    shards, starts = max(8, sizes["n"] // SHARD_TOKENS), sizes["docs"]
    with reading_state(spark):
        # what the shards answer is left beside the model's rows: a byte a key
        counted = saved(counted_keys(sent_keys(state, shards)), "counted")
        per = counted.where("stretch IS NULL").select("kind", "total", F.posexplode("types").alias("r", "types")).groupBy("kind", "r")
        per = per.agg(F.sum("types").alias("types"), F.sum("total").alias("total")).collect()  # at most 2 (TOP + 3) rows
        of = {kind: {r["r"]: r["types"] for r in per if r["kind"] == kind} for kind in (WORDS, PAIRS)}
        n, types = sizes["n"], sum(of[WORDS].values())
        d1, d2 = discounts(of[WORDS]), discounts(of[PAIRS])
        held = n - sum((1 - d1[r - 1]) * r * of[WORDS].get(r, 0) for r in range(1, TOP + 1))  # discounted tokens
        unknown = max(1 - held / n, 0.5 / (n + 1)) if n else 1.0
        sums = history_sums(state, counted, shards, unknown, held, d1, d2)
        words = saved(model_words(sums, counted.where(F.col("stretch").isNull() & (F.col("kind") == WORDS)), starts, unknown), "words")
    none = F.lit(None).cast("binary")
    pairs = counted.where(F.col("stretch").isNull() & (F.col("kind") == PAIRS)).select("shard", "kind", "keys", "counts", none.alias("share"), none.alias("backoff"))
    return Model(words, pairs, int(n), int(types), float(unknown), float(held), d1, d2, int(shards))


_SUMS = "shard int, keys binary, counted binary, p_sum binary"


def history_sums(state: DataFrame, counted: DataFrame, shards: int, unknown: float, held: float, d1: list[float], d2: list[float]) -> DataFrame:
    """For each stretch and shard: the histories of the pairs that the stretch owns, their discounted counts, and the
    probabilities of the words after them."""

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        out, rows = [], right.to_pylist()
        for row in left.to_pylist():
            stretch = Stretch(row)
            p = word_share(answers(rows, WORDS, "counts", counts_of), unknown, held, d1)
            c = answers(rows, PAIRS, "counts", counts_of)
            parts = sorted((r for r in rows if r["kind"] == PAIRS), key=lambda r: r["shard"])
            mine = np.concatenate([bits_of(r["mine"], int(np.frombuffer(r["counts"], dtype=np.int64, count=1)[0])) for r in parts])
            token = stretch.token[mine]
            first, second = stretch.before[token], stretch.at[token]
            sums = [np.bincount(first, weights=w, minlength=len(stretch.words)) for w in (discounted(c[mine], d2), p[second])]
            own = np.flatnonzero(np.bincount(first, minlength=len(stretch.words)))
            keys, sums = stretch.words[own], [x[own] for x in sums]
            out += [(s, packed(keys[a:b]), *[x[a:b].tobytes() for x in sums]) for s, a, b in parts_of(shard_of(keys, shards))]
        return pa.Table.from_batches([_batch(_SUMS, out)])

    replies = counted.where("stretch IS NOT NULL").select("stretch", "shard", "kind", "counts", "mine")
    return state.groupBy("stretch").cogroup(replies.groupBy("stretch")).applyInArrow(add, _SUMS)


_MODEL = "shard int, kind int, keys binary, counts binary, share binary, backoff binary"


def model_words(sums: DataFrame, words: DataFrame, starts: int, unknown: float) -> DataFrame:
    """The model's rows of words; a word that is no history has backoff 1."""

    def merge(left: pa.Table, right: pa.Table) -> pa.Table:
        met, known = left.to_pylist(), [r for r in right.to_pylist() if r["keys"] is not None]
        keys = np.concatenate([unpacked(r["keys"]) for r in known] or [np.empty(0, np.uint64)])
        c = np.concatenate([counts_of(r["counts"]) for r in known] or [np.empty(0, np.int64)])
        of = np.concatenate([unpacked(r["keys"]) for r in met] or [np.empty(0, np.uint64)])
        every, back = np.unique(np.concatenate([keys, of]), return_inverse=True)
        own, times = np.zeros(len(every), np.int64), np.where(every == np.uint64(START), starts, 0)
        own[back[: len(keys)]] = c
        times = np.maximum(times, own)
        share, backoff = np.zeros(len(every)), np.zeros(len(every))
        at = back[len(keys) :]
        counted, p_sum = (np.bincount(at, weights=np.concatenate([doubles(r[x]) for r in met] or [np.empty(0)]), minlength=len(every)) for x in ("counted", "p_sum"))
        is_history = counted > 0
        t, q = times[is_history], counted[is_history] / times[is_history]
        scale = np.minimum(1.0, (1 - 0.5 / (t + 1)) / q)
        share[is_history] = np.log10(scale / t)
        backoff[is_history] = np.log10((1 - q * scale) / np.maximum(1 - p_sum[is_history], unknown))
        shard = (met or right.to_pylist())[0]["shard"]
        rows = [(shard, WORDS, packed(every), small_counts(own), share.tobytes(), backoff.tobytes())] if len(every) else []
        return pa.Table.from_batches([_batch(_MODEL, rows)])

    return sums.groupBy("shard").cogroup(words.select("shard", "keys", "counts").groupBy("shard")).applyInArrow(merge, _MODEL)


_MET = "stretch bigint, shard int, kind int, counts binary, share binary, backoff binary"


def met_keys(sent: DataFrame, table: DataFrame) -> DataFrame:
    """The model's values for each stretch's keys; nought for those it does not know."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        known = {kind: [r for r in right.to_pylist() if r["kind"] == kind and r["keys"] is not None] for kind in (WORDS, PAIRS)}
        tables = {kind: (unpacked(r[0]["keys"]), [counts_of(r[0]["counts"]), *([doubles(r[0][c]) for c in ("share", "backoff")] if kind == WORDS else [])]) for kind, r in known.items() if r}
        out = []
        for r in left.to_pylist():
            ids = unpacked(r["keys"])
            keys, values = tables.get(r["kind"], (None, [np.zeros(1, np.int64), *([np.zeros(1)] * 2 if r["kind"] == WORDS else [])]))
            at = np.zeros(len(ids), np.int64) if keys is None else np.minimum(np.searchsorted(keys, ids), len(keys) - 1)
            hit = np.zeros(len(ids), bool) if keys is None else keys[at] == ids
            counts, *rest = [np.where(hit, v[at], 0) for v in values]
            out.append((r["stretch"], r["shard"], r["kind"], small_counts(counts), *([x.tobytes() for x in rest] or [None, None])))
        return pa.Table.from_batches([_batch(_MET, out)])

    return sent.groupBy("shard").cogroup(table.groupBy("shard")).applyInArrow(meet, _MET)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``base_score`` and ``score`` of every row."""
    kind, spark = docs.schema["doc_id"].dataType.simpleString(), docs.sparkSession
    whole = model.n + SMOOTH * (model.types + 1)
    unknown, held, d1, d2 = model.unknown, model.held, model.d1, model.d2
    columns = "doc_id string, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        out, rows = [], right.to_pylist()
        for row in left.to_pylist():
            stretch = Stretch(row)
            c, share, backoff = (answers(rows, WORDS, x, read) for x, read in (("counts", counts_of), ("share", doubles), ("backoff", doubles)))
            met = answers(rows, PAIRS, "counts", counts_of)
            p = np.log10(np.where(c > 0, word_share(c, unknown, held, d1), unknown))
            counted = np.log10(np.where(met > 0, discounted(met, d2), 1.0))
            seen = (met > 0)[stretch.pair]
            logs = np.where(seen, counted[stretch.pair] + share[stretch.before], backoff[stretch.before] + p[stretch.at])
            base = np.log10((c + SMOOTH) / whole)[stretch.at]
            sums = [np.add.reduceat(x, stretch.starts) for x in ((c > 0)[stretch.at].astype(np.int64), base, logs)]
            out.append(pa.RecordBatch.from_arrays([pa.array(stretch.doc_id, pa.string()), pa.array(stretch.held_out, pa.bool_()), *map(pa.array, [stretch.sizes, *sums])], names=[x.split()[0] for x in columns.split(", ")]))
        return pa.Table.from_batches(out) if out else pa.Table.from_batches([_batch(columns, [])])

    with scratch(spark) as keep:
        with arrow_rows(spark, 256):
            state = keep(state_rows(inputs(docs)), "state", "stretch")
        with reading_state(spark):
            # the words' answers are the longest; they are not written, but sent on to the stretches at once
            met = met_keys(sent_keys(state, model.shards, (WORDS,), numbers=False), model.words)
            for part in range(PASSES):
                of_part = model.pairs.where(F.col("shard") % PASSES == part)
                found = met_keys(sent_keys(state, model.shards, (PAIRS,), part, numbers=False), of_part)
                met = met.unionByName(keep(found, "met"))
            done = state.groupBy("stretch").cogroup(met.groupBy("stretch")).applyInArrow(add, columns)
            return saved(done.withColumn("doc_id", F.col("doc_id").cast(kind)), "scores")


_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "array<bigint>": pa.list_(pa.int64())}


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    """Rows as a batch of a schema written as DDL."""
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _TYPES[t]) for i, (_, t) in enumerate(fields)], names=[c for c, _ in fields])
