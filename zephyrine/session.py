"""Sessions with the settings that the engine's semantics rely on."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

#: ANSI errors on overflow and division by zero, and a fixed zone, are part of the semantics.
SEMANTICS = {"spark.sql.ansi.enabled": "true", "spark.sql.session.timeZone": "UTC"}
#: Run-time planning: skewed partitions split, small ones merged.
PLANNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(name: str = "zephyrine", master: str | None = None, **conf: str) -> SparkSession:
    """A session by the given settings (dots as double underscores in names)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for k, v in {**SEMANTICS, **PLANNING, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only where there are no other machines may it be unset."""
    said = spark.conf.get("spark.checkpoint.dir", None)
    if said:
        return said.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="zephyrine-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def ship(spark: SparkSession | None = None) -> None:
    """Let Python workers import this package.

    In local mode they find it where the driver does. On a cluster it is sent to the executors as an archive,
    once a context, so it need not be installed there.
    """
    spark = spark or SparkSession.active()
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc = spark.sparkContext
    if sc.master.startswith("local"):
        env = sc.environment
        paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
        if root not in paths:
            env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    elif not getattr(sc, "_zephyrine_sent", False):
        path = os.path.join(tempfile.mkdtemp(prefix="zephyrine-"), "zephyrine.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(os.path.join(root, "zephyrine")):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, root))
        sc.addPyFile(path)
        sc._zephyrine_sent = True
