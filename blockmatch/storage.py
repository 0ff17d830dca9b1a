"""Tables written to the shared work folder, to cut lineage and to keep results stable.

The folder is the one that ``spark.checkpoint.dir`` names.  Only where that is
unset (tests, a single machine) a temporary folder is made.  Written tables
survive lost executors, and are removed when the driver's Python ends.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a join side that may be broadcast, times its bytes a row: at most this many bytes.
BROADCAST_BYTES = 32 << 20

#: Settings while tables of whole texts are written, each a ceiling: rows and bytes of an Arrow batch between the JVM and
#: Python, and rows of a batch of the Parquet reader, whose arrays grow to hold the texts of a batch end to end.
LEAN = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": 1024,
    "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20,
    "spark.sql.parquet.columnarReaderBatchSize": 512,
}

_made: dict[int, str] = {}


def work_dir(spark: SparkSession) -> str:
    """A folder of this driver's own below the shared one."""
    key = id(spark.sparkContext)
    if key not in _made:
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if not root:
            root = "file://" + tempfile.mkdtemp(prefix="blockmatch-")
            spark.sparkContext.setCheckpointDir(root)
        _made[key] = f"{root.rstrip('/')}/blockmatch-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _made[key])
    return _made[key]


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is not None and context._gateway is not None:
        try:
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the JVM may be gone already; the folder is then left to whoever owns the store
            pass


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def go_lean(spark: SparkSession) -> dict[str, str]:
    """The session's settings held down to ``LEAN``, and what they were."""
    old = {}
    for key, most in LEAN.items():
        now = spark.conf.get(key)
        if not 0 < _bytes(now) <= most:
            old[key] = now
            spark.conf.set(key, str(most))
    return old


def _bytes(value: str) -> int:
    """A number that may have a unit such as ``64MB``; 0 where it is not one."""
    number = value.rstrip("bB")
    unit = "kmgt".find(number[-1:].lower()) + 1 if number else 0
    number = number[:-1] if unit else number
    return int(number) << 10 * unit if number.isdigit() else 0


@contextlib.contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """The ``LEAN`` settings for the jobs run inside."""
    old = go_lean(spark)
    try:
        yield
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """The same rows, read back from a table in the shared folder."""
    path = new_path(df.sparkSession, name)
    with lean(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int | Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows, counted at ``row_bytes`` each, fit ``limit``; else unchanged, and Spark shuffles."""
    each = F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes
    return F.broadcast(df) if (df.agg(F.sum(each)).first()[0] or 0) <= limit else df
