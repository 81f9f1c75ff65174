"""Tables cut into buckets by a hash of their key; one commit changes several of them, all or nothing.

A commit n writes its files under ``<table>/n=<n>``: of a merged table only the buckets that its changes touch, of an
appended table its new rows.  What counts is written last: a manifest that names, for each merged table and bucket, the
commit that holds its newest content; appended rows count up to the newest manifest's number.  A run that stops before
the manifest leaves nothing behind that readers see, and the next run writes the same number again.

Buckets that two newer manifests no longer name are deleted, so readers of the manifest before still find theirs.  A
manifest has a row for each merged table and bucket; it is all the driver holds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from sofralytics.sources import versions

MANIFEST = "table string, bucket int, n int"
BUCKET = "bucket"


class Store:
    """The tables under one folder."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root, buckets

    def committed(self) -> int:
        """The newest commit's number, -1 before the first."""
        return max(versions.numbers(self.spark, f"{self.root}/commits"), default=-1)

    def manifest(self, n: int | None = None) -> dict[tuple[str, int], int]:
        """(table, bucket) -> the commit that holds its content, as of commit n."""
        n = self.committed() if n is None else n
        if n not in versions.numbers(self.spark, f"{self.root}/commits"):
            return {}
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/commits/v={n}").collect()
        return {(r["table"], r["bucket"]): r["n"] for r in rows}

    def bucket_of(self, keys: Sequence[str]) -> Column:
        return F.pmod(F.hash(*keys), F.lit(self.buckets))

    def read(self, table: str, schema: StructType, only: Sequence[int] | None = None) -> DataFrame:
        """A merged table, or some of its buckets."""
        held = {b: n for (t, b), n in self.manifest().items() if t == table and (only is None or b in set(only))}
        if not held:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{table}/n={n}/{BUCKET}={b}" for b, n in sorted(held.items())])

    def appended(self, table: str, schema: StructType) -> DataFrame:
        """The committed rows of an appended table."""
        if not versions.exists(self.spark, f"{self.root}/{table}"):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(StructType([*schema.fields, StructField("n", IntegerType())])).parquet(f"{self.root}/{table}")
        return rows.filter(F.col("n") <= self.committed()).drop("n")

    def commit(self, n: int | None = None) -> Commit:
        return Commit(self, self.committed() + 1 if n is None else n)


class Commit:
    """Changes that become visible together with ``finish``."""

    def __init__(self, store: Store, n: int):
        self.store, self.n = store, n
        self.changed: dict[tuple[str, int], int] = {}
        versions.remove(store.spark, [f"{store.root}/staged/n={n}"])

    def _path(self, table: str) -> str:
        return f"{self.store.root}/{table}/n={self.n}"

    def stage(self, frame: DataFrame, name: str) -> DataFrame:
        """The rows written once, for several uses in this commit; gone when it is finished."""
        path = f"{self.store.root}/staged/n={self.n}/{name}"
        frame.write.mode("overwrite").parquet(path)
        return self.store.spark.read.schema(frame.schema).parquet(path)

    def append(self, table: str, frame: DataFrame) -> None:
        frame.write.mode("overwrite").parquet(self._path(table))

    def merge(self, table: str, changes: DataFrame, keys: Sequence[str], merge: Callable[[DataFrame, DataFrame], DataFrame], schema: StructType | None = None) -> None:
        """Rewrite the buckets that the changes touch as ``merge(stored rows of these buckets, changes)``.

        ``keys`` are columns of both sides that tell the bucket; a bucket that grew large is written by several tasks.
        """
        schema = changes.schema if schema is None else schema
        bucket = self.store.bucket_of(keys)
        touched = sorted(r[0] for r in changes.select(bucket).distinct().collect())  # at most as many as there are buckets
        if not touched:
            return
        merged = merge(self.store.read(table, schema, touched), changes).select(*schema.names).withColumn(BUCKET, bucket)
        merged.hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(self._path(table))
        self.changed |= {(table, b): self.n for b in touched}

    def finish(self) -> None:
        """Write the manifest, then delete what no reader needs any more."""
        store = self.store
        before, last = store.manifest(self.n - 2), store.manifest(self.n - 1)
        now = store.manifest() | self.changed
        rows = [(t, b, n) for (t, b), n in sorted(now.items())]
        versions.write(store.spark.createDataFrame(rows, MANIFEST).coalesce(1), f"{store.root}/commits", self.n)
        kept = set(now.items()) | set(last.items())
        gone = [f"{store.root}/{t}/n={n}/{BUCKET}={b}" for (t, b), n in before.items() if ((t, b), n) not in kept]
        versions.remove(store.spark, [*gone, f"{store.root}/staged/n={self.n}"])
