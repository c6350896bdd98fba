"""How tables lie on disk: buckets for lookups and joins by key, sort order for ranges.

A database's hash index becomes buckets, its ordered index becomes files sorted by key, whose statistics
let a scan skip most of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """Saved as a table in buckets of ``keys``, sorted there: lookups read one bucket, and joins of tables
    bucketed alike need no shuffle."""
    df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(table)
    return df.sparkSession.table(table)


def clustered(df: DataFrame, path: str, keys: Sequence[str], files: int) -> DataFrame:
    """Saved in files that follow one another by ``keys``, each sorted: ranges read few of them."""
    df.repartitionByRange(files, *keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def hash_slots(df: DataFrame, keys: Sequence[str], slots: int = 8096) -> DataFrame:
    """``df`` with ``slot``: the hash of the keys, as rows are dealt to partitions."""
    from pyspark.sql import functions as F

    return df.withColumn("slot", F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int"))
