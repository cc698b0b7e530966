"""Session settings and the one place that decides where checkpoints go."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import ExitStack, contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str | None = None, app: str = "twinlens", **conf: str) -> SparkSession:
    """A session with the settings the operators assume; cluster settings win where given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if master and master.startswith("local"):
        # Local runs only: on a cluster the shuffle width is set by its operator.
        defaults["spark.sql.shuffle.partitions"] = "8"
        defaults["spark.driver.memory"] = os.environ.get("TWINLENS_DRIVER_MEMORY", "12g")
    defaults.update(conf)
    for key, value in defaults.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share, from `spark.checkpoint.dir`; set here only where a local session leaves it unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="twinlens-checkpoint-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def run_folder(spark: SparkSession) -> str:
    """This application's folder for intermediate tables. It goes when the driver's JVM ends, or with `end_run`."""
    place = f"{ensure_checkpoint_dir(spark).rstrip('/')}/twinlens-{spark.sparkContext.applicationId}"
    system, path = _file_system(spark, place)
    system.mkdirs(path)
    system.deleteOnExit(path)
    return place


def end_run(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results that still read them end with it."""
    place = f"{ensure_checkpoint_dir(spark).rstrip('/')}/twinlens-{spark.sparkContext.applicationId}"
    system, path = _file_system(spark, place)
    system.delete(path, True)


def _file_system(spark: SparkSession, place: str):
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(context._jsc.hadoopConfiguration()), path


def is_folder(spark: SparkSession, place: str) -> bool:
    system, path = _file_system(spark, place)
    return system.getFileStatus(path).isDirectory()


def child_names(spark: SparkSession, place: str) -> list[int]:
    """The numbers that name the folders in a place, in order; none if the place is not there."""
    system, path = _file_system(spark, place)
    if not system.exists(path):
        return []
    names = [status.getPath().getName() for status in system.listStatus(path)]
    return sorted(int(name) for name in names if name.isdigit())


def spread(df: DataFrame, task_bytes: int = 128 << 20) -> DataFrame:
    """A table of fewer bytes than its tasks could hold, dealt to all of them; a larger one as it lies.

    A file of one row group is one task, however many bytes of text are worked through for each one read. Tables beyond
    `task_bytes` a task have row groups enough, and are not shuffled.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(tasks) if size < tasks * task_bytes else df


def spread_thin(df: DataFrame, task_bytes: int = 256 << 10) -> DataFrame:
    """A narrow table of which much is derived, dealt to tasks of so few stored bytes each, however large it is.

    Neither the cores that are there when the table is read nor its row groups set how long a task runs.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(max(tasks, -(-size // task_bytes)))


def parts_of(stored: DataFrame, task_bytes: int = 8 << 20) -> int:
    """How many parts of so many stored bytes a table makes; no fewer than there are cores."""
    tasks = stored.sparkSession.sparkContext.defaultParallelism
    size = int(stored._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(tasks, -(-size // task_bytes))


def dealt(stored: DataFrame, keys: list[str], task_bytes: int = 8 << 20) -> DataFrame:
    """A stored table dealt by its keys to tasks of so many stored bytes each, however large it is.

    What follows by the same keys needs no other shuffle, and a task's memory does not grow with the table.
    """
    return stored.repartition(parts_of(stored, task_bytes), *keys)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the run's folder, not yet there."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a result that several readers share to the run's folder, and read it back.

    A table there survives executor loss, unlike a cached copy. Parquet rather than row
    checkpoints: readers prune columns, and the planner knows the real size before it picks
    a join.
    """
    place = scratch_path(df.sparkSession, "table")
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


@contextmanager
def meanwhile(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A Spark setting that holds only while this is open."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def shuffles_end_with_their_action(spark: SparkSession):
    """While open, an action's shuffle files go when it ends; for actions whose results are stored or collected."""
    return meanwhile(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


@contextmanager
def little_disk(spark: SparkSession) -> Iterator[None]:
    """While open, stored tables are packed more tightly, and shuffle files go when the table they were made for is stored."""
    with ExitStack() as held:
        held.enter_context(shuffles_end_with_their_action(spark))
        held.enter_context(meanwhile(spark, "spark.sql.parquet.compression.codec", "zstd"))
        yield


def let_go(stored: DataFrame) -> None:
    """Delete a table of the run's folder that nothing will read any more."""
    spark = stored.sparkSession
    for place in {file.rsplit("/", 1)[0] for file in stored.inputFiles()}:
        if f"/twinlens-{spark.sparkContext.applicationId}/table-" in place:
            system, path = _file_system(spark, place)
            system.delete(path, True)


def own_name(df: DataFrame, key: str) -> DataFrame:
    """The same rows; `key` no longer bears the name of its table, for whose sake a union forgets how its parts are dealt."""
    return df.withColumn(key, F.col(key).alias(key, metadata={"own": True}))


def stored_by(df: DataFrame, key: str, parts: int, order: Sequence[str] = ()) -> DataFrame:
    """`cut_lineage` for rows dealt by `key` to so many parts, which readers know: sums, windows and joins by `key`, or by it
    and more, of tables with as many parts shuffle nothing; joins by more only where the result is stored in this way too.

    A frame that is dealt so already is not shuffled to be written. `order` lays like values side by side, so that they
    take less room. The bucketed table has its name only until it is read; the rows stay in the run's folder.
    """
    spark = df.sparkSession
    name = f"spark_catalog.default.twinlens_{uuid.uuid4().hex}"
    written = df.repartition(parts, key).write.bucketBy(parts, key).sortBy(key, *order)
    with little_disk(spark), meanwhile(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
        written.option("path", scratch_path(spark, "table")).saveAsTable(name)
    stored = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return own_name(stored, key)
