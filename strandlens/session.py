"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_MAX_ROWS = 200_000
"""Row bound under which a table of a few narrow columns may be broadcast (about 10 MB)."""


BROADCAST_MAX_BYTES = 64 << 20


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Settings the library is tuned for; none of them changes a result."""
    return (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )


def is_local(spark: SparkSession) -> bool:
    """Whether driver and tasks are one process on this machine."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder in ``spark.checkpoint.dir``.

    Only in local mode may that setting be absent: then a folder of this machine is used, and removed at
    the end. On a cluster each executor would write to its own disk, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not is_local(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(own)
        base = spark.sparkContext.getCheckpointDir() or own
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


_shipped: set[str] = set()


def ship_package(spark: SparkSession, *more: str) -> None:
    """Sends this package, and packages or modules at the paths ``more``, to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "strandlens-package.zip")
    atexit.register(shutil.rmtree, os.path.dirname(target), ignore_errors=True)
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for top in (os.path.dirname(os.path.abspath(__file__)), *more):
            above = os.path.dirname(top)
            files = [top] if os.path.isfile(top) else [os.path.join(d, f) for d, _, names in os.walk(top) for f in names]
            for f in sorted(files):
                if f.endswith(".py"):
                    archive.write(f, os.path.relpath(f, above))
    context.addPyFile(target)


def is_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows and ``max_bytes`` bytes; counts no further than one row beyond.

    Strings count their bytes, nested columns those of their JSON, all others 8 bytes.
    """
    width = F.lit(0)
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        kind = field.dataType.typeName()
        if kind in ("array", "map", "struct"):
            column, kind = F.to_json(F.struct(column)), "string"
        size = F.coalesce(F.octet_length(column), F.lit(0)) if kind in ("string", "binary") else F.lit(8)
        width = width + size
    rows, size = df.limit(max_rows + 1).select(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes
