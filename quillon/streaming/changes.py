"""The change log as a batch and as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.operators.store import CHANGES_SCHEMA, Store


def read_changes(changes: DataFrame, after: tuple[int, int] = (0, -1), collection_id: str | None = None, limit: int = 500, low_water: int | None = None) -> DataFrame:
    """Changes after a cursor (xid, seq), in order. Those of commits at or over ``low_water`` stay hidden until nothing older is open."""
    xid, seq = after
    df = changes.filter((F.col("xid") > xid) | ((F.col("xid") == xid) & (F.col("seq") > seq)))
    if low_water is not None:
        df = df.filter(F.col("xid") < low_water)
    if collection_id is not None:
        df = df.filter(F.col("collection_id") == collection_id)
    return df.orderBy("xid", "seq").limit(limit)


def stream_changes(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """The log below a store's root as a stream: each visible commit's file once, resumed from the query's checkpoint."""
    return spark.readStream.schema(CHANGES_SCHEMA).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(folder)


def follow(store: Store, checkpoint: str, apply: Callable[[DataFrame, int], None], collection_id: str | None = None) -> None:
    """Calls ``apply`` with the current state (data null once deleted) of each document that changed, a batch at a time.

    State is read again by name, so repeated or late events do no harm. A commit's events come after it has become visible.
    """
    store.publish_changes()
    changes = stream_changes(store.spark, f"{store.root}/v*/changes")
    if collection_id is not None:
        changes = changes.filter(F.col("collection_id") == collection_id)

    def batch(df: DataFrame, number: int) -> None:
        names = df.select(F.col("doc_name").alias("name")).distinct()
        apply(names.join(store.documents(), "name", "left"), number)

    query = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
