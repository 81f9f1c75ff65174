"""Quality rules on documents, judged with their hosts.

Every text is measured once, whole, in Arrow batches; the measures (a few numbers a row) are written.  A host's share of
failing documents is shrunk towards a beta prior fitted to all hosts by moments, so that a host with two documents is
not condemned by one of them.  Hosts are summed by partial aggregation; their verdicts join back on the host, where
adaptive execution broadcasts a small table or splits a hot host.

Null and empty texts have no words and fail the base rules.  A null host is a host of its own.  Repeated rows count and
return once each; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sofralytics.llm.common import mapped, word_blocks

# What counts as a symbol, and the limits of the rules.
SYMBOLS = b"#*$%&|<>"
WINDOW, MIN_WORDS, MAX_REPEATED_PCT = 5, 10, 20
MAX_SYMBOLS_PCT, MAX_DUP_LINES_PCT = 30, 50
MAX_HOST_RATE = 0.5

_BLANKS = bytes([0x20, *range(0x09, 0x0E)])
_NOT_COUNTED = _BLANKS + bytes(range(0x80, 0xC0))  # blanks, and all but the first byte of a character
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def repeated_words(ids: np.ndarray, width: int = WINDOW) -> int:
    """How many words lie in windows of ``width`` words that the text has twice or more."""
    n = len(ids)
    if n <= width:
        return 0
    mixed = np.zeros(n - width + 1, dtype=np.uint64)
    for k in range(width):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[k : n - width + 1 + k].astype(np.uint64) + np.uint64(1)
    if len(np.unique(mixed)) == len(mixed):  # equal windows have equal sums
        return 0
    code, base = ids, int(ids.max()) + 1
    for k in range(1, width):  # exact: windows are numbered by their first k words and the next one
        _, code = np.unique(code[:-1] * base + ids[k:], return_inverse=True)
    twice = np.bincount(code)[code] > 1
    covered = np.zeros(n, dtype=bool)
    for k in range(width):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum())


def measure(text: bytes) -> tuple[int, ...]:
    """The values of ``MEASURES``."""
    numbers: dict[bytes, int] = {}
    parts = [np.array([numbers.setdefault(w, len(numbers)) for w in block], dtype=np.int64) for block in word_blocks(text)]
    ids = np.concatenate(parts) if parts else np.empty(0, np.int64)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(ids),
        len(text.translate(None, _NOT_COUNTED)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(ids),
    )


def measures(docs: DataFrame, host: Column) -> DataFrame:
    """``doc_id``, ``host`` and the measures of every row."""
    kept = docs.select("doc_id", host.cast("string").alias("host"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([measure(t) for t in batch.column(2).to_pylist()], dtype=np.int64).reshape(-1, len(MEASURES))
            columns = [pa.array(found[:, i]) for i in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "host", *MEASURES])

    return mapped(kept, run, f"doc_id {kind}, host string, " + ", ".join(f"{m} bigint" for m in MEASURES), "measures")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PCT * F.col("n_words"))


def rule_failed() -> Column:
    """Any rule of a document: the base rules, too many symbols, too many repeated lines."""
    symbols = 100 * F.col("n_symbols") > MAX_SYMBOLS_PCT * F.col("n_words")
    lines = 100 * F.col("n_dup_lines") > MAX_DUP_LINES_PCT * F.col("n_lines")
    return base_failed() | symbols | lines


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """(a, b) of the beta distribution whose mean and spread the hosts' failure rates have; one row reaches the driver.

    The spread that chance alone gives is taken off.  Without hosts, failures or successes the prior is (1, 1) scaled
    to the mean.
    """
    rate = F.col("failed") / F.col("n")
    row = hosts.agg(
        F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.count("*").alias("hosts"), F.sum(F.col("failed") * rate).alias("square")
    ).first()
    if not row["n"]:
        return 1.0, 1.0
    n, mean = float(row["n"]), row["failed"] / row["n"]
    if mean in (0.0, 1.0):
        return 2 * mean + 1e-3, 2 * (1 - mean) + 1e-3
    spread = row["square"] / n - mean * mean
    by_chance = mean * (1 - mean) * row["hosts"] / n
    between = max(spread - by_chance, 1e-6)
    strength = min(max(mean * (1 - mean) / between - 1, 2.0), 1e6)
    return mean * strength, (1 - mean) * strength


def judged(measured: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The measures with ``base_failed``, ``rule_failed``, ``host_rate`` (shrunk), ``host_kept`` and ``kept``."""
    flagged = measured.withColumns({"base_failed": base_failed(), "rule_failed": rule_failed()})
    hosts = flagged.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("rule_failed").cast("bigint")).alias("failed"))
    a, b = beta_prior(hosts)
    rate = (F.col("failed") + a) / (F.col("n") + a + b)
    verdicts = hosts.select(F.col("host").alias("_host"), rate.alias("host_rate"), (rate <= max_rate).alias("host_kept"))
    joined = flagged.join(verdicts, flagged["host"].eqNullSafe(verdicts["_host"])).drop("_host")
    return joined.withColumn("kept", ~F.col("rule_failed") & F.col("host_kept"))


def apply_rules(docs: DataFrame, host: Column, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    return judged(measures(docs, host), max_rate)
