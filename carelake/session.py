"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import contextlib
import contextvars
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

_handed_out: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scratch folders of the open scope", default=None)


def get_spark(master: str | None = None, app: str = "carelake", **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder every executor can reach: under ``spark.checkpoint.dir``, else under the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    app = spark.sparkContext.applicationId
    path = f"{base.rstrip('/')}/carelake/{app}/{label}-{uuid.uuid4().hex[:12]}"
    scope = _handed_out.get()
    if scope is not None:
        scope.append(path)
    return path


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Scratch folders handed out inside are removed at the end, so what reads them must be written by then."""
    folders: list[str] = []
    token = _handed_out.set(folders)
    try:
        yield
    finally:
        _handed_out.reset(token)
        for folder in folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
