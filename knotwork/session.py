"""Session helpers: where shared scratch data lives and how lineage is cut."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
# Independent tasks of a driver that run their Spark jobs at the same time.
PARALLEL_TASKS = 4


def local_session(cores: str = "*", partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A one-machine session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("knotwork")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one in local mode only."""
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_CONF, None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="knotwork-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


_OWN_FOLDERS: set[str] = set()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder below the shared one that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for a table that is written and read back.

    Results may still read such tables, so they live as long as the application: its folder is
    removed when the driver ends.
    """
    folder = f"{checkpoint_root(spark).rstrip('/')}/knotwork/{spark.sparkContext.applicationId}"
    if folder not in _OWN_FOLDERS:
        _OWN_FOLDERS.add(folder)

        def clean() -> None:
            with contextlib.suppress(Exception):  # the session may be gone already
                remove(spark, folder)

        atexit.register(clean)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back.

    Loops then neither grow lineage nor lose state with an executor. A written table also carries
    its true size, while a checkpoint keeps the estimated size of the plan behind it, and those
    estimates multiply from round to round.
    """
    spark = df.sparkSession
    path = scratch(spark, "state")
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._knotwork_path = path
    return written


def discard(state: DataFrame) -> None:
    """Removes the files of loop state that ``cut`` wrote and nothing reads any more."""
    path = getattr(state, "_knotwork_path", None)
    if path:
        remove(state.sparkSession, path)


def replace(written: DataFrame, part: DataFrame) -> DataFrame:
    """``part`` of a written table as loop state: it is discarded with the table."""
    part._knotwork_path = getattr(written, "_knotwork_path", None)
    return part


def renew(old: DataFrame | None, df: DataFrame) -> DataFrame:
    """``cut`` for loop state: once the new state is written, the files of the old one are removed."""
    new = cut(df)
    if old is not None:
        discard(old)
    return new


def in_parallel(session: SparkSession, tasks: Sequence[Callable[[], Any]]) -> list:
    """Run independent tasks as concurrent Spark jobs; the data stays on the executors."""
    with ThreadPoolExecutor(PARALLEL_TASKS) as pool:
        return [future.result() for future in [pool.submit(inheritable_thread_target(session)(task)) for task in tasks]]
