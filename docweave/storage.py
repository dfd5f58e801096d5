"""Tables that cut lineage, kept in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table may be broadcast if it has at most so many rows, counted, and so many bytes on disk, looked up.
BROADCAST_ROWS, BROADCAST_BYTES = 20_000, 8_000_000

_written: dict[str, tuple[SparkSession, list[str]]] = {}
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a temporary one of our own, but only if driver and
    executors are one process: executors of a cluster would each write to their own disk and lose tables with it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        own = tempfile.mkdtemp(prefix="docweave-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _own[app] = f"file://{own}"
    return _own[app]


def stored(df: DataFrame, name: str = "table", by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lost executors lose nothing of it.

    With ``by`` in folders of that column's values, so that a filter on it reads only its own. The tables of a session
    go when its process ends, or by :func:`dropped`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docweave/{name}-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _written:
        _written[app] = (spark, [])
        atexit.register(dropped, spark)
    _written[app][1].append(path)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession) -> int:
    """Delete the stored tables of the session's application; results that read them are then gone. Returns their number."""
    try:
        app = spark.sparkContext.applicationId
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    except Exception:  # the session has been stopped
        return 0
    _, paths = _written.pop(app, (spark, []))
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    return len(paths)


def bytes_of(df: DataFrame) -> int:
    """Bytes of the files a plan reads; what it filters out counts too, so it is a bound for stored tables."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def join_sized(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a stored ``right``: broadcast if its counted rows are within ``limit`` and its bytes within
    BROADCAST_BYTES, else by shuffle, where adaptive execution splits skewed partitions."""
    small = bytes_of(right) <= BROADCAST_BYTES and right.limit(limit + 1).count() <= limit
    return left.join(F.broadcast(right) if small else right, on, how)
