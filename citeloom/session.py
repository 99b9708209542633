"""Session factory, table access and the shared scratch folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "citeloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE, Arrow and UTC; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset (tests, a single machine) a temporary folder is set for the session.
    """
    sc = spark.sparkContext
    set_by_cluster = sc.getConf().get("spark.checkpoint.dir")
    if set_by_cluster:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(set_by_cluster)
        return set_by_cluster.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="citeloom-"))
    return sc.getCheckpointDir().rstrip("/")


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_written: list[tuple[SparkSession, str]] = []


@atexit.register
def _clear() -> None:
    for spark, path in _written:
        try:
            remove_path(spark, path)
        except Exception:  # noqa: BLE001 - the session may have ended
            pass


def clear_scratch(spark: SparkSession) -> int:
    """Remove what ``materialize`` and ``scratch_path`` have put into the shared folder so far.

    For long sessions, between two queries: DataFrames that were built before must not be used
    afterwards. Returns the number of paths removed.
    """
    mine = [(s, p) for s, p in _written if s is spark]
    for s, p in mine:
        remove_path(s, p)
        _written.remove((s, p))
    return len(mine)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed by ``clear_scratch`` or when the driver ends."""
    path = f"{shared_dir(spark)}/citeloom/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back.

    The written table outlives any executor, is columnar and compressed, and pins values
    such as generated ids that must not change when a task is run again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, factor: int = 1) -> DataFrame:
    """Repartition only when the input has fewer partitions than the session has cores.

    A large input keeps its scan partitions (no shuffle); a small single file, which would
    otherwise run in one task, is spread over the cores.
    """
    want = df.sparkSession.sparkContext.defaultParallelism * factor
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df
