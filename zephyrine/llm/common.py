"""Shared plumbing: Arrow batches with bounded text, lineage cuts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephyrine import session
from zephyrine.session import shared_folder

#: Characters of text that are held in Python objects at once (one longer text stands alone).
CHARS_AT_ONCE = 1 << 20


#: Bytes of a batch that goes to Python, where the session does not say; rows differ much in length.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Let Python workers import the package, and bound the batches they get by bytes besides rows."""
    session.ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back, so that later steps
    neither repeat its work nor depend on executors that may be lost.

    What the planner knows of ``df`` (sizes it guessed, constraints that grow with every step) is cut off too.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    written = df.checkpoint(eager=True)._jdf
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(written.queryExecution().toRdd(), written.schema(), False), spark)


def tidy(spark: SparkSession) -> None:
    """Let the driver collect its garbage, as only then Spark removes shuffle files that nothing needs any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Give memory that this worker holds but does not use back to the machine; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: its own ways have to do


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a task's work on batches, with :func:`release` at its end."""

    def to_the_end(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return to_the_end


def chunks(
    batches: Iterator[pa.RecordBatch], text: int, limit: int = CHARS_AT_ONCE
) -> Iterator[list[list]]:
    """Columns of each batch as Python lists, in pieces of at most ``limit`` characters in column ``text``.

    Null texts come out as empty strings; other columns keep their nulls.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = batch.column(text).nbytes
        step = max(1, min(n, int(n * limit / max(size, 1)) or 1))
        at = 0
        while at < n:
            part = batch.slice(at, step)
            cols = [c.to_pylist() for c in part.columns]
            cols[text] = [t or "" for t in cols[text]]
            at += step
            if step == 1 or sum(map(len, cols[text])) <= 2 * limit:
                yield cols
                continue
            lo, held = 0, 0
            for i, t in enumerate(cols[text]):
                if i > lo and held + len(t) > limit:
                    yield [c[lo:i] for c in cols]
                    lo, held = i, 0
                held += len(t)
            yield [c[lo:] for c in cols]


def map_texts(
    df: DataFrame,
    columns: list,
    text: int,
    make: Callable[[], Callable[[list[list]], list[list]]],
    schema: T.StructType,
    limit: int = CHARS_AT_ONCE,
) -> DataFrame:
    """Apply, per piece of at most ``limit`` characters, what ``make()`` returns in each task.

    ``columns`` are selected first, so other columns of ``df`` (whatever their names) are neither
    read nor in the way. The function gets lists of column values and returns lists for ``schema``.
    """
    ship(df.sparkSession)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        step = make()
        for cols in chunks(batches, text, limit):
            out = step(cols)
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(out, arrow, strict=True)], names=names
            )

    return df.select(*columns).mapInArrow(released(run), schema)


def keep_rows(
    df: DataFrame, text: str, make: Callable[[], Callable[[list[str]], list[bool]]], limit: int = CHARS_AT_ONCE
) -> DataFrame:
    """Rows of ``df`` for whose text the predicate holds. Only texts go to Python and only verdicts come back;
    every column passes through untouched."""
    ship(df.sparkSession)

    @F.arrow_udf(T.BooleanType())
    def holds(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        step = make()
        for column in batches:
            mask: list[bool] = []
            for (texts,) in chunks(iter([pa.RecordBatch.from_arrays([column], names=["t"])]), 0, limit):
                mask += step(texts)
            yield pa.array(mask, type=pa.bool_())
        release()

    return df.where(holds(F.col(f"`{text}`").cast("string")))


def id_text(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> list:
    """The two columns that most operators read, by plain names."""
    return [F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")]


def crc_mod(doc_id: str, mod: int):
    """crc32 of an id's decimal text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).cast("binary")) % mod
