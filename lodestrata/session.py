"""Session helpers: building a session, cutting lineage in the shared folder, shipping the package."""

from __future__ import annotations

import io
import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def local_session(cores: str | int = "*", partitions: int = 8, memory: str = "20g") -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lodestrata")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, unless their PYTHONPATH has it."""
    context = spark.sparkContext
    if getattr(context, "_lodestrata_shipped", False) or str(PACKAGE.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(PACKAGE.rglob("*")):
            if path.is_file() and path.suffix in (".py", ".txt") and "__pycache__" not in path.parts:
                archive.write(path, Path(PACKAGE.name) / path.relative_to(PACKAGE))
    folder = tempfile.mkdtemp(prefix="lodestrata_")  # read by the driver's file server only
    target = os.path.join(folder, "lodestrata_pkg.zip")
    Path(target).write_bytes(buffer.getvalue())
    context.addPyFile(target)
    context._lodestrata_shipped = True


#: Whether the files that a query shuffled are removed when it ends.
_REMOVED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, eager: bool = True, release: bool = False) -> DataFrame:
    """Cut the lineage by a reliable checkpoint.

    With release, files that this step shuffled are removed once it is written; otherwise they stay
    until the driver happens to collect its garbage. The setting holds for this step only.

    The folder is the one in spark.checkpoint.dir, which every executor shares, so lost executors
    lose nothing. Only where it is unset and all runs in one JVM a folder of our own is used; on a
    cluster that would be lost with its machine, so there it raises.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not re.fullmatch(r"local(\[[^,\]]*(?:,[^\]]*)?\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="lodestrata_checkpoint_"))
    if not (release and eager):
        return df.checkpoint(eager)
    before = spark.conf.get(_REMOVED, None)
    spark.conf.set(_REMOVED, "true")
    try:
        # a plan of its own, since the setting is read when a plan is made
        return df.select("*").checkpoint()
    finally:
        spark.conf.unset(_REMOVED) if before is None else spark.conf.set(_REMOVED, before)


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
