"""Session defaults and the shared working folder."""

from __future__ import annotations

import gc

from pyspark.sql import SparkSession


def build_session(app_name: str = "periodica", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings the operators are designed for; ``conf`` wins over them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.parquet.compression.codec": "zstd",
        # Lists of codes are compared with row groups value by value, not by their least and greatest.
        "spark.sql.parquet.pushdown.inFilterThreshold": "200",
        # Generated code of a session that asks many different questions stays compiled.
        "spark.sql.codegen.cache.maxEntries": "1000",
    }
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, for tables that cut lineage: the one in ``spark.checkpoint.dir``."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not configured:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return configured.rstrip("/")


def release_shuffles(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files of finished jobs, whose results are written.

    Its cleaner goes by the driver's garbage, which a driver with room to spare does not collect for long: the files of all steps
    of a load would lie on the disks together.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
