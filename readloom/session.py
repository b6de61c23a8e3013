"""Session defaults and the lineage helper shared by the iterative operators."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def build_session(cores: str = "8", app: str = "readloom") -> SparkSession:
    """A local session with the settings the jobs are tuned for."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # sequence columns dominate shuffles; zstd packs ACGT close to 2 bits a base
        .config("spark.io.compression.codec", "zstd")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Only a local session with nothing configured gets a folder of its own.
    """
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="readloom-ckpt-")
        sc.setCheckpointDir(shared)
        shared = sc.getCheckpointDir()
    return f"{shared}/readloom-{sc.applicationId}"


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_scope: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scratch_scope", default=None)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    Plans of loops stay short, lost executors cost nothing, and later joins are
    planned with the true size of the table.  A checkpointed frame would keep
    the size estimates of the plan it came from, which multiply from join to
    join until planning itself is what takes the time.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    with _shuffles_go(spark):
        df.write.parquet(path)
    return _scratch_table(spark.read.schema(df.schema).parquet(path), path)


@contextlib.contextmanager
def dealt_table(df: DataFrame, key: str) -> Iterator[DataFrame]:
    """``df`` written to the shared folder in files by ``key``, which joins on it read without a shuffle.

    The catalog knows the table until the block ends.
    """
    spark = df.sparkSession
    name = f"readloom_{uuid.uuid4().hex}"
    path = f"{scratch_folder(spark)}/{name}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with _shuffles_go(spark):
        df.repartition(parts, key).write.bucketBy(parts, key).option("path", path).format("parquet").saveAsTable(name)
    table = _scratch_table(spark.table(name), path)
    try:
        yield table
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


@contextlib.contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write go with it: nothing reads them again, and else they lie on the disks until the driver collects garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def _scratch_table(out: DataFrame, path: str) -> DataFrame:
    out._scratch_path = path
    if (held := _scope.get()) is not None:
        held.append(path)
    return out


class Scratch:
    """Tables that ``cut_lineage`` wrote since the scope began."""

    def __init__(self, spark: SparkSession, paths: list[str]):
        self.spark, self.paths, self.kept = spark, paths, set()

    def keep(self, *frames: DataFrame) -> None:
        """Tables that outlive the scope."""
        self.kept |= {f._scratch_path for f in frames}

    def drop(self, *frames: DataFrame) -> None:
        """Tables nothing will read again."""
        self.delete([f._scratch_path for f in frames])

    def delete(self, paths: list[str]) -> None:
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
            if path in self.paths:
                self.paths.remove(path)


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[Scratch]:
    """Deletes the tables written inside when it ends, but for those that were kept.

    What a scope keeps belongs to the scope around it.
    """
    paths: list[str] = []
    outer = _scope.get()
    token = _scope.set(paths)
    scratch = Scratch(spark, paths)
    try:
        yield scratch
    finally:
        _scope.reset(token)
        if outer is not None:
            outer.extend(scratch.kept)
        scratch.delete([p for p in paths if p not in scratch.kept])


def spread(df: DataFrame) -> DataFrame:
    """Give a scan that arrived as too few partitions one partition per core.

    Large inputs already have more splits than cores and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def keep(df: DataFrame) -> DataFrame:
    """Persist a frame several branches of one plan read.

    Blocks spill to disk and are recomputed from lineage when an executor goes.
    """
    return df.persist(StorageLevel.MEMORY_AND_DISK)


# a key outside the K most frequent ones holds at most 1/K of all rows
HOT_KEYS = 1_000


def join_bounded(rows: DataFrame, lookup: DataFrame, keys: str | list[str], hot_keys: int = HOT_KEYS) -> DataFrame:
    """Inner join to a lookup with few rows per key, safe when a key is hot.

    Rows of the most frequent keys meet their lookup rows through a broadcast of
    at most ``hot_keys`` keys and stay where they are; the others are shuffled
    and none of their keys holds more than a small share.
    """
    keys = [keys] if isinstance(keys, str) else keys
    busy = (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .orderBy(F.col("_n").desc(), *keys)
        .limit(hot_keys)
        .select(*keys)
    )
    hot = F.broadcast(lookup.join(F.broadcast(busy), keys, "left_semi"))
    rest = rows.join(F.broadcast(busy), keys, "left_anti").join(lookup, keys)
    return rows.join(hot, keys).unionByName(rest)


def global_index(df: DataFrame, order: list, name: str) -> DataFrame:
    """0-based position of every row in a total order, without a one-task window.

    Rows are range-sorted; only the row count of each partition is gathered.
    """
    placed = cut_lineage(
        df.orderBy(*order).withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    )
    return _offset_index(placed, ["_pid"], name)


def _offset_index(placed: DataFrame, group: list[str], name: str) -> DataFrame:
    """Turns consecutive ``_mid`` runs, one per ``group``, into one running index."""
    runs = placed.groupBy(*group).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy(*group).rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    return placed.join(starts, group).withColumn(name, F.col("_start") + F.col("_mid") - F.col("_first")).drop(
        "_pid", "_mid", "_first", "_start"
    )
