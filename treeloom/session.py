"""Session settings, the shared folder for written intermediates, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

class NotConverged(RuntimeError):
    """A loop reached its limit of rounds before its result was settled."""


#: Rows of a narrow side (ids and numbers) up to which a counted side is broadcast.
BROADCAST_ROWS = 200_000


def build_session(master: str = "local[*]", app: str = "treeloom", **conf: str) -> SparkSession:
    """A session with the settings the engine counts on; keyword keys use ``__`` for dots."""
    builder = SparkSession.builder.master(master).appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; in local mode only, a temporary one where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    held = getattr(shared_dir, "_local", None)
    if held:
        return held
    master = spark.conf.get("spark.master", "local")
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    held = tempfile.mkdtemp(prefix="treeloom-")
    atexit.register(shutil.rmtree, held, ignore_errors=True)
    shared_dir._local = held
    return held


def begin_run(spark: SparkSession, name: str) -> str:
    """Gather the tables that follow in one folder of the shared one, until the next run begins; returns its path for :func:`clear`."""
    folder = f"{shared_dir(spark)}/treeloom-{name}-{uuid.uuid4().hex[:12]}"
    spark._treeloom_run = folder
    return folder


def run_dir(spark: SparkSession) -> str:
    """The folder of the current run; a run without a name begins where there is none."""
    held = getattr(spark, "_treeloom_run", None)
    return held if held and held.startswith(shared_dir(spark)) else begin_run(spark, "run")


def clear(spark: SparkSession, folder: str) -> None:
    """Delete a run's folder.  Its result is lazy and reads the folder: write the result first."""
    drop_table(spark, folder)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that run inside are deleted as each ends; otherwise they stay until the driver happens to collect its garbage."""
    held = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if held is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, held)


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Cut the lineage: write ``df`` to the shared folder and read it back.  Returns the table and its path."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a written intermediate that no later step reads."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def small_side(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, else as it is (Spark then shuffles the join).

    Give ``rows`` where the count is known; otherwise one counting job runs.
    """
    if rows is None:
        rows = df.count()
    return F.broadcast(df) if rows <= limit else df


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, unless PYTHONPATH already does."""
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    context = spark.sparkContext
    if root in [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p] or getattr(context, "_treeloom_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="treeloom-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(os.path.join(folder, "treeloom_code"), "zip", root, os.path.basename(package)))
    context._treeloom_shipped = True
