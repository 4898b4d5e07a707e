"""Session settings, and tables written between the stages of a job."""

from __future__ import annotations

import contextlib
import os
import pathlib
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "reelspark", master: str | None = None, shuffle_partitions: int | None = None, shared: str | None = None, extra: dict[str, str] | None = None) -> SparkSession:
    """Session with the settings the operators assume; a cluster may override any of them.

    shared: folder for intermediate tables where the session has none configured. extra: further settings.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (({"spark.checkpoint.dir": shared} if shared else {}) | (extra or {})).items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("REELSPARK_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once per application, so that they need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = pathlib.Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="reelspark-ship-")
    name = f"{folder}/{root.name}.zip"
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as file:
        for path in sorted(root.rglob("*.py")):
            file.write(path, path.relative_to(root.parent))
    context.addPyFile(name)  # the driver serves it to whoever runs its tasks
    _SHIPPED.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors share: the one `spark.checkpoint.dir` names.

    A session in one process that names none gets a folder of its own, since nothing else has to see it. On
    a cluster a path of the machine's own file system may be mounted everywhere or not, which its name does
    not tell, so it is tried out.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="reelspark-")
        context.setCheckpointDir(folder)
    folder = folder.rstrip("/")
    if not context.master.startswith("local"):
        _try_out(spark, folder)
    return folder


_TRIED: set[tuple[str, str]] = set()


def _try_out(spark: SparkSession, folder: str) -> None:
    """Refuse a folder in which the driver does not find what the executors wrote; once per application.

    Without this, tables of a folder that each machine has for itself would come back with rows missing.
    """
    context = spark.sparkContext
    if (context.applicationId, folder) in _TRIED:
        return
    place = context._jvm.org.apache.hadoop.fs.Path(folder)
    if place.getFileSystem(context._jsc.hadoopConfiguration()).getUri().getScheme() == "file":
        path = f"{folder}/{context.applicationId}/trial-{uuid.uuid4().hex}"
        tasks = 2 * context.defaultParallelism  # one row each, so that every executor writes some
        spark.range(0, tasks, 1, tasks).write.parquet(path)
        if (found := spark.read.schema("id long").parquet(path).count()) != tasks:
            raise ValueError(f"{folder} lies on one machine, {found} of {tasks} rows came back: name a folder shared by all executors")
    _TRIED.add((context.applicationId, folder))


def folder_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store its URL names."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it ends; otherwise they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREED)
        else:
            spark.conf.set(_FREED, before)


def materialise(df: DataFrame, name: str = "step", partition_by: str | None = None) -> DataFrame:
    """Cut lineage: write `df` as a table in the shared folder and read it back.

    The copy survives lost executors, and later readers still prune columns and push filters down.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
