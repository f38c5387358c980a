"""Session and folder helpers."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "loomvec", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests, the
    bench) a temporary folder is made, kept in the session's settings and
    removed at the end; a cluster without the setting is refused.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors see")
        folder = tempfile.mkdtemp(prefix="loomvec-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", found)
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


#: What ``materialize`` has written in this process.
_written: list[str] = []


def materialize(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Writes ``df`` into the shared folder and reads it back.

    Cuts the lineage and gives the planner the true size; the files survive
    the loss of any executor. ``small``: the rows are few beside the input, so
    they are gathered in files by the cluster's cores and its setting of
    shuffle partitions, whichever asks for more.
    """
    spark = df.sparkSession
    if small:
        df = df.repartition(max(4, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4))
    path = f"{shared_dir(spark)}/loomvec-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> int:
    """Deletes the tables that ``materialize`` has written; results that read them must be stored before."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    gone = 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lowers the session's Arrow batches to at most ``rows`` rows, for whole texts that are read by plans which run later."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting for what is executed inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what is executed inside.

    Whole texts make large batches; both sides hold one or two of them.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if 0 < int(before) < rows:
        yield
        return
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
