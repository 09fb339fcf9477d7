"""Session settings and the shared scratch folder."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from siterank.sources.tables import read_parquet


def build_session(app_name: str = "siterank", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the plans of this package are written for."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # The default page limit per site is 10,000: let ranked filters of that
        # size drop rows before the shuffle, not only those up to 1,000.
        "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per application.

    The Arrow helpers are imported there, wherever the driver found the package.
    """
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent
        archive = shutil.make_archive(
            str(Path(tempfile.mkdtemp(prefix="siterank-")) / "siterank_package"),
            "zip",
            package.parent,
            package.name,
        )
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)
    return spark


_SHIPPED: set[str] = set()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, from the session wherever it is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            configured = tempfile.mkdtemp(prefix="siterank-")
        context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def broadcast_limit(spark: SparkSession) -> int:
    """Largest table in bytes that the session broadcasts, -1 for none."""
    jconf = spark._jsparkSession.sessionState().conf()
    return jconf.autoBroadcastJoinThreshold()


def estimated_bytes(df: DataFrame) -> int:
    """Spark's own estimate; for a materialized table it is the size of its files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


@contextmanager
def settings_of(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with other settings inside; those it had come back after."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside are deleted after each write, not whenever the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, spread_by: str | None = None) -> DataFrame:
    """Compute ``df`` once, as a table in the shared folder.

    The lineage ends there, lost executors cost nothing, and Spark knows the true
    size of the table when it plans what follows.  Its shuffle files are deleted: the
    table takes their place.
    """
    path = scratch_path(df.sparkSession, "table")
    with released_shuffles(df.sparkSession):
        df.write.parquet(path)
    return read_parquet(df.sparkSession, path, spread_by, df.schema)


def drop_table(df: DataFrame) -> None:
    """Delete a table of ``materialize`` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getName().startswith("table-"):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
