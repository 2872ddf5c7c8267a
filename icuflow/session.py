"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(master: str | None = None, app: str = "icuflow", **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(master: str, checkpoints: str | None, warehouse: str) -> str:
    """The folder for staged tables: ``spark.checkpoint.dir``, which all executors share, else one in the warehouse.

    A warehouse on a local disk serves only a local master; elsewhere each executor would write to its own disk.
    """
    if checkpoints:
        return checkpoints.rstrip("/")
    if not master.startswith("local[") and master != "local" and (warehouse.startswith("file:") or "://" not in warehouse):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share; the warehouse {warehouse} is local")
    return f"{warehouse.rstrip('/')}/_staged"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for a staged table, see :func:`scratch_root`."""
    root = scratch_root(
        spark.conf.get("spark.master", "local"), spark.conf.get("spark.checkpoint.dir", None), spark.conf.get("spark.sql.warehouse.dir"),
    )
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"
