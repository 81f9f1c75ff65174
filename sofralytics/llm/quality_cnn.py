"""Quality of a text by a byte-level convolutional network in numpy.

Filters over ``WIDTH`` bytes run along the whole text; each is max-pooled over overlapping chunks of two ``BLOCK``s that
cover the text; the chunks' mean and maximum are combined into one probability.  A filter is a table of weights for
each byte value at each place, so a convolution is a sum of look-ups.

Learning uses at most ``SAMPLE`` labelled rows of at most ``SAMPLE_BYTES`` bytes, chosen by hash of the id from the rows
that are not held out, whole texts each; it runs on the driver on that bounded sample.  Only bytes of the text are
inputs.  Scoring runs in Arrow batches where the rows are; a text is worked through in stretches of ``STRETCH`` bytes.

Null texts count as empty and get the score of a text without chunks; repeated texts get equal scores; rows whose label
is null do not teach, several labels of a document count as their highest; without any labelled row all scores are 0.5;
an empty table gives an empty table; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sofralytics.llm.common import crc_mod

WIDTH, FILTERS, BLOCK, STRETCH = 6, 16, 128, 1 << 16
PAD = 256  # the value of places behind the text
SAMPLE, SAMPLE_BYTES, EPOCHS, STEPS, BATCH, RATE, SEED = 1500, 16_384, 10, 400, 32, 0.02, 7  # STEPS: at least so many
FOLDS, THRESHOLD = 5, 0.3


@dataclass
class Network:
    filters: np.ndarray  # WIDTH x 257 x FILTERS
    bias: np.ndarray  # FILTERS
    mean_weights: np.ndarray  # FILTERS
    max_weights: np.ndarray  # FILTERS
    offset: float

    @staticmethod
    def fresh(rng: np.random.Generator) -> Network:
        filters = rng.normal(0, 0.1, (WIDTH, PAD + 1, FILTERS)).astype(np.float32)
        return Network(filters, np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, FILTERS).astype(np.float32), np.zeros(FILTERS, np.float32), 0.0)

    @staticmethod
    def indifferent() -> Network:
        zero = np.zeros(FILTERS, np.float32)
        return Network(np.zeros((WIDTH, PAD + 1, FILTERS), np.float32), zero, zero, zero, 0.0)


def padded(text: bytes) -> np.ndarray:
    """Byte values, filled up with ``PAD`` to whole blocks (one at least) and the reach of the last filter place."""
    blocks = max(1, -(-len(text) // BLOCK))
    out = np.full(blocks * BLOCK + WIDTH - 1, PAD, dtype=np.int16)
    out[: len(text)] = np.frombuffer(text, dtype=np.uint8)
    return out


def convolved(net: Network, codes: np.ndarray) -> np.ndarray:
    """blocks x BLOCK x FILTERS; places behind the text are far below zero."""
    n = len(codes) - WIDTH + 1
    out = np.take(net.filters[0], codes[:n], axis=0, mode="clip")
    held = np.empty_like(out)
    for k in range(1, WIDTH):
        out += np.take(net.filters[k], codes[k : k + n], axis=0, out=held, mode="clip")
    out[codes[:n] == PAD] = -1e4
    return out.reshape(-1, BLOCK, FILTERS)


def score(net: Network, text: bytes) -> float:
    codes = padded(text)
    n = len(codes) - WIDTH + 1
    blocks = np.concatenate([convolved(net, codes[i : min(i + STRETCH, n) + WIDTH - 1]).max(axis=1) for i in range(0, n, STRETCH)])
    chunks = np.maximum(blocks[:-1], blocks[1:]) if len(blocks) > 1 else blocks
    chunks = np.maximum(chunks + net.bias, 0)
    logit = float((chunks.mean(axis=0) * net.mean_weights).sum() + (chunks.max(axis=0) * net.max_weights).sum()) + net.offset
    return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def learn(texts: list[bytes], labels: list[int]) -> Network:
    """Adam on the logistic loss; gradients flow to the places that won their chunk only."""
    if not texts:
        return Network.indifferent()
    rng = np.random.default_rng(SEED)
    net = Network.fresh(rng)
    coded = [padded(t) for t in texts]
    goal = np.array(labels, dtype=np.float32)
    share = float(np.clip(goal.mean(), 0.01, 0.99))
    net.offset = float(np.log(share / (1 - share)))
    names = ("filters", "bias", "mean_weights", "max_weights", "offset")
    first = {k: np.zeros_like(np.asarray(getattr(net, k), dtype=np.float32)) for k in names}
    second = {k: np.zeros_like(v) for k, v in first.items()}
    t, epochs = 0, max(EPOCHS, -(-STEPS * BATCH // len(texts)))
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            grads = _gradients(net, [coded[i] for i in order[at : at + BATCH]], goal[order[at : at + BATCH]])
            t += 1
            rate = RATE * (1 - epoch / epochs)
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * grads[k]
                second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                step = rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
                setattr(net, k, float(net.offset - step) if k == "offset" else (getattr(net, k) - step).astype(np.float32))
    return net


def _gradients(net: Network, coded: list[np.ndarray], goal: np.ndarray) -> dict[str, np.ndarray]:
    grads = {"filters": np.zeros(net.filters.size), "bias": np.zeros(FILTERS), "mean_weights": np.zeros(FILTERS), "max_weights": np.zeros(FILTERS), "offset": np.float64(0)}
    lanes = np.arange(FILTERS)
    for codes, y in zip(coded, goal, strict=True):
        out = convolved(net, codes)
        where = out.argmax(axis=1)
        best = np.take_along_axis(out, where[:, None, :], axis=1)[:, 0, :]
        where = where + np.arange(len(best))[:, None] * BLOCK
        if len(best) > 1:
            later = best[1:] > best[:-1]
            where, best = np.where(later, where[1:], where[:-1]), np.maximum(best[1:], best[:-1])
        chunks = np.maximum(best + net.bias, 0)
        mean, top = chunks.mean(axis=0), chunks.max(axis=0)
        logit = np.clip((mean * net.mean_weights).sum() + (top * net.max_weights).sum() + net.offset, -30, 30)
        miss = 1 / (1 + np.exp(-logit)) - y
        grads["mean_weights"] += miss * mean
        grads["max_weights"] += miss * top
        grads["offset"] += miss
        flow = np.broadcast_to(miss * net.mean_weights / len(chunks), chunks.shape).copy()
        flow[chunks.argmax(axis=0), lanes] += miss * net.max_weights
        flow[chunks <= 0] = 0
        grads["bias"] += flow.sum(axis=0)
        for k in range(WIDTH):
            index = (k * (PAD + 1) + codes[where + k].astype(np.int64)) * FILTERS + lanes
            grads["filters"] += np.bincount(index.ravel(), weights=flow.ravel(), minlength=net.filters.size)
    grads["filters"] = grads["filters"].reshape(net.filters.shape)
    return {k: np.asarray(v / len(coded), dtype=np.float32) for k, v in grads.items()}


def held_out(doc_id: Column) -> Column:
    return crc_mod(doc_id, FOLDS) == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Network:
    """The network learnt from a bounded sample of labelled rows that are not held out.

    The ids are chosen first, so the texts are met by a broadcast of at most ``sample`` ids and not shuffled.
    """
    known = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ranked = F.xxhash64(F.lit(SEED), F.col("doc_id"))
    chosen = known.orderBy(ranked, "doc_id").limit(sample).select(F.col("doc_id").alias("_id"), "quality")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= sample_bytes)
    rows = texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["_id"]).select("doc_id", F.col("text").cast("binary").alias("text"), "quality")
    rows = rows.orderBy(ranked, "doc_id", F.xxhash64("text")).limit(sample).collect()
    return learn([bytes(r["text"]) for r in rows], [int(r["quality"]) for r in rows])


def scorer(net: Network):
    """A column function: probability of quality 1 of a text given as binary."""

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([score(net, b"" if t is None else bytes(t)) for t in texts], dtype="float64")

    return probability


def text_score(net: Network, text: str = "text") -> Column:
    return scorer(net)(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score reaches the threshold, with their own columns."""
    net = train(docs, labels)
    return docs.where(text_score(net) >= threshold)
