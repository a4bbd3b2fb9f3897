"""Copying, comparing and measuring collections."""

from __future__ import annotations

import statistics as _stats
import time
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from quillon.functions import values as V


@F.pandas_udf(T.LongType())
def document_size(data: pd.Series) -> pd.Series:
    """Estimated bytes of tagged documents."""
    return data.map(lambda s: V.size_estimate(V.loads(s)))


@F.pandas_udf(T.BinaryType())
def document_key(data: pd.Series) -> pd.Series:
    """Bytes that are equal where documents are equal, with integers and doubles told apart."""

    def strict(v):
        if isinstance(v, dict):
            return {k: strict(x) for k, x in v.items()}
        if isinstance(v, list):
            return [strict(x) for x in v]
        return [type(v).__name__, v] if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return data.map(lambda s: V.sort_key(strict(V.loads(s))))


def size_of(kind: str, col: Column) -> Column:
    """The size estimate of a native column."""
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(col) + 2, F.lit(1)).cast("long")
    return F.when(col.isNull(), 1).otherwise(16).cast("long")


def missing(source: DataFrame, copy: DataFrame, on: str = "name") -> DataFrame:
    """Rows of the source that the copy lacks."""
    return source.join(copy.select(on), on, "left_anti")


def mismatches(source: DataFrame, copy: DataFrame, on: str, columns: Iterable[str]) -> DataFrame:
    """Ids in both whose columns differ; NaN equals NaN, null equals null, -0.0 equals 0.0."""
    columns = list(columns)
    other = copy.select(F.col(on).alias("_on"), *[F.col(c).alias(f"_c_{c}") for c in columns])
    differ = F.lit(False)
    for c in columns:
        differ = differ | ~F.col(c).eqNullSafe(F.col(f"_c_{c}"))
    return source.join(other, source[on] == other["_on"]).filter(differ).select(on)


def verify(source: DataFrame, copy: DataFrame, on: str, columns: Iterable[str]) -> DataFrame:
    """One row: source, checked, missing, mismatch. One pass of one join."""
    columns = list(columns)
    other = copy.select(F.col(on).alias("_on"), F.lit(True).alias("_there"), *[F.col(c).alias(f"_c_{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_c_{c}"))
    there = F.coalesce("_there", F.lit(False))
    count = lambda c: F.count(F.when(c, 1)).alias
    return source.join(other, source[on] == other["_on"], "left").agg(F.count(F.lit(1)).alias("source"), count(there)("checked"), count(~there)("missing"), count(there & ~same)("mismatch"))


def every_nth(df: DataFrame, on: str, n: int, ranges: int | None = None) -> DataFrame:
    """Every n-th row by id, for a sampled check. Ranks are numbered within ranges of ids and joined by range offsets.

    The ranges' bounds are ids of a bounded sample, picked by hash, and go into the plan as values, so that sizes and ranks
    agree however often they are computed. Null ids count first and are never picked.
    """
    if n <= 1:
        return df
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sample = sorted(r[0] for r in df.select(on).filter(F.col(on).isNotNull()).orderBy(F.xxhash64(on), on).limit(20 * ranges).collect())
    bounds = sorted({sample[k * len(sample) // ranges] for k in range(1, ranges)}) if sample else []
    kind = df.schema[on].dataType
    over = F.size(F.filter(F.array(*[F.lit(b).cast(kind) for b in bounds]), lambda b: b <= F.col(on))) if bounds else F.lit(0)
    ranged = df.select(on).withColumn("_p", F.when(F.col(on).isNull(), 0).otherwise(over).cast("int"))
    sizes = sorted((r._p, r.n) for r in ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect())
    before, offsets = 0, []
    for p, k in sizes:
        offsets.append((p, before))
        before += k
    local = ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(on)))
    base = spark.createDataFrame(offsets, "_p int, _o long")
    picked = local.join(F.broadcast(base), "_p").filter((F.col("_i") + F.col("_o") - 1) % n == 0).select(on)
    return df.join(picked, on, "left_semi")


def copy_ids(source: DataFrame, ids: DataFrame, on: str = "name") -> tuple[DataFrame, DataFrame]:
    """Documents of listed ids, and the ids that are not there."""
    wanted = ids.select(on).distinct()
    return source.join(wanted, on, "left_semi"), wanted.join(source.select(on), on, "left_anti")


def import_documents(source: DataFrame, target: str, checkpoint: str) -> int:
    """Copies a streaming source of documents into Parquet, resuming where a run ended. Returns the batches done."""
    query = source.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return (query.lastProgress or {}).get("batchId", -1) + 1


class RateLimit:
    """At most ``per_second`` documents in each second's window; a batch beyond that goes alone."""

    def __init__(self, per_second: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.per_second, self.clock, self.sleep = per_second, clock, sleep
        self.began, self.used = clock(), 0

    def wait(self, n: int) -> None:
        if self.per_second <= 0:
            return
        now = self.clock()
        if now - self.began >= 1:
            self.began, self.used = now, 0
        if self.used and self.used + n > self.per_second:
            self.sleep(max(0.0, 1 - (now - self.began)))
            self.began, self.used = self.clock(), 0
        self.used += n


def export_documents(documents: DataFrame, put: Callable[[list], None], per_second: int = 400, batch: int = 500, dry_run: bool = False) -> int:
    """Sends documents in batches to ``put``, which runs on executors, within a rate over all partitions. Returns how many."""
    share = max(1, per_second // max(1, documents.rdd.getNumPartitions())) if per_second > 0 else 0
    if dry_run:
        return documents.count()

    def send(rows):
        limit, pending = RateLimit(share), []
        for r in rows:
            pending.append(r.asDict())
            if len(pending) >= batch:
                limit.wait(len(pending))
                put(pending)
                pending = []
        if pending:
            limit.wait(len(pending))
            put(pending)

    documents.foreachPartition(send)
    return documents.count()


def bench(calls: dict[str, Callable[[], object]], rounds: int = 20, warm: int = 3) -> dict[str, dict[str, float]]:
    """Interleaved timings of calls: p50, p90, p95, p99 and mean, in milliseconds."""
    for _ in range(warm):
        for f in calls.values():
            f()
    times: dict[str, list[float]] = {k: [] for k in calls}
    for _ in range(rounds):
        for k, f in calls.items():
            t = time.perf_counter()
            f()
            times[k].append((time.perf_counter() - t) * 1000)
    cut = lambda v, p: sorted(v)[min(len(v) - 1, int(p * len(v)))]
    return {k: {"p50": cut(v, 0.5), "p90": cut(v, 0.9), "p95": cut(v, 0.95), "p99": cut(v, 0.99), "avg": _stats.mean(v)} for k, v in times.items()}


def latency_histogram(timings: DataFrame, col: str, edges_ms: Iterable[float]) -> DataFrame:
    """Cumulative counts of timings up to each edge."""
    edges = F.explode(F.array(*[F.lit(float(e)) for e in edges_ms]))
    return timings.withColumn("edge", edges).groupBy("edge").agg(F.count(F.when(F.col(col) <= F.col("edge"), 1)).alias("n")).orderBy("edge")
