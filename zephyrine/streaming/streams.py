"""Structured Streaming over the store's logs and over event tables."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from zephyrine.sources.store import EVENTS, Store


def events(store: Store, rel: str) -> DataFrame:
    """The log of a relation as a stream of EVENTS: what was committed, in any order within a batch."""
    return store.spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").parquet(store.log_path(rel))


def deliver(store: Store, rel: str, handle: Callable[[DataFrame, int], None], checkpoint: str, forever: bool = False) -> StreamingQuery:
    """Hand batches of a relation's events to ``handle(rows, batch)``, each at least once, resuming from
    ``checkpoint``. Ends when nothing is left, unless ``forever``."""
    writer = events(store, rel).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.start() if forever else writer.trigger(availableNow=True).start()


def replay(log: DataFrame, key: str, schema: str) -> DataFrame:
    """The table that a log of EVENTS leaves: each key's last event by LSN and statement, unless it is a delete."""
    row = F.from_json("data", schema)
    last = log.select(row.alias("r"), "lsn", "step", "cmd").groupBy(F.col(f"r.{key}").alias("k")).agg(
        F.max_by(F.struct("r", "cmd"), F.struct("lsn", "step")).alias("last")
    )
    return last.where("last.cmd = 'write'").select("last.r.*")


def windowed(df: DataFrame, ts: str, keys: list[str], size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts by window of event time; rows later than ``late`` are dropped when streaming."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    if df.isStreaming:
        df = df.withWatermark(ts, late)
    return df.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("begin"), F.col("w.end").alias("finish"), *keys, "n")


def watch(test: Callable[[], bool], every: float = 0.1, most: float = 60.0) -> None:
    """Wait until ``test()`` holds; too long raises."""
    until = time.monotonic() + most
    while not test():
        if time.monotonic() > until:
            raise TimeoutError("watch: the condition did not come true")
        time.sleep(every)


def watch_sql(spark: SparkSession, expression: str, **how) -> None:
    """:func:`watch` over an SQL expression."""
    watch(lambda: bool(spark.sql(f"SELECT {expression} AS x").first()[0]), **how)
