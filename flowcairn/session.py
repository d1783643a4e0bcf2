"""Session helpers: a tuned local session for tests, and lineage cuts that survive executor loss."""

from __future__ import annotations

import tempfile
import threading
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowcairn.functions.numeric import quoted


def local_session(cores: int = 8, app: str = "flowcairn", memory: str = "8g") -> SparkSession:
    """A local session for tests and benches; on a cluster, pass in the session you already have."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named in ``spark.checkpoint.dir``.

    A private folder is set only for a local session that names none; a cluster without a shared
    folder is an error, because a machine-local folder is lost together with its executor.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if configured:
        if current is None:
            context.setCheckpointDir(configured)
        return configured
    if current is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="flowcairn-ckpt-"))
    return context.getCheckpointDir()


_OPEN = threading.local()
COLLECT_SECONDS = 5.0  # between two collections of what nobody holds any longer
_collected = [0.0]


def _note(path: str | None) -> None:
    if path and getattr(_OPEN, "paths", None):
        _OPEN.paths[-1].append(path)


def _checkpoint_path(df: DataFrame) -> str | None:
    """The folder that a cut table is read from."""
    found = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    return found.get() if found.isDefined() else None


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so later stages do not recompute it."""
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    _note(_checkpoint_path(out))
    return out


def let_go(df: DataFrame) -> None:
    """Delete the files of a cut table that nothing reads any longer."""
    path = _checkpoint_path(df)
    if path:
        _delete(df.sparkSession, path)


def open_blocks() -> int:
    """How many ``scratch`` blocks this thread is in."""
    return len(getattr(_OPEN, "paths", ()))


@contextmanager
def owned_by(level: int):
    """What is cut inside belongs to the block that was the innermost of ``level`` open ones."""
    paths = getattr(_OPEN, "paths", [])
    inside = paths[level:]
    del paths[level:]
    try:
        yield
    finally:
        paths.extend(inside)


def _collect(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of tables that nobody holds once they were collected."""
    if time.monotonic() - _collected[0] > COLLECT_SECONDS:
        spark._jvm.System.gc()
        _collected[0] = time.monotonic()


@contextmanager
def scratch(spark: SparkSession):
    """Tables that this thread cuts or writes inside are deleted at the end, and shuffles that nobody holds go too.

    Yields ``keep``, which cuts a table that outlives the block; an outer block deletes it at its own end.
    Nothing lazy that reads a deleted table may leave the block.
    """
    if not hasattr(_OPEN, "paths"):
        _OPEN.paths = []
    level = open_blocks()
    _collect(spark)
    _OPEN.paths.append([])

    def keep(df: DataFrame) -> DataFrame:
        with owned_by(level):
            return cut_lineage(df)

    try:
        yield keep
    finally:
        for path in _OPEN.paths.pop():
            _delete(spark, path)
        _collect(spark)


def written_parts(df: DataFrame, by: str) -> DataFrame:
    """Write ``df`` once as columns to the shared checkpoint folder, a folder per value of the integer ``by``.

    Readers open only the columns and the values of ``by`` that they ask for.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/parts-{uuid.uuid4().hex}"
    _note(path)
    df.write.option("compression", "zstd").partitionBy(by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*[F.col(quoted(c)) for c in df.columns])
