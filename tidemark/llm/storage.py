"""What the operators share: tables kept in the checkpoint folder, so that a lost executor costs no
earlier stage; callers' columns held where no internal name meets them; bounded batches of text."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_KEPT: list[str] = []

#: Bytes of a batch on its way to Python, and rows of a vectorized Parquet batch: texts may be long.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": "2m", "spark.sql.parquet.columnarReaderBatchSize": "1024"}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder in local mode and an error elsewhere."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tidemark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    made = f"file://{folder}"
    spark.sparkContext.setCheckpointDir(made)
    return made


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._tidemark_path = path
    _KEPT.append(path)
    return kept


@atexit.register
def _forget_at_exit() -> None:
    """What nobody has deleted goes with the process, if its session still runs."""
    spark = SparkSession.getActiveSession()
    if _KEPT and spark is not None and spark.sparkContext._jsc is not None:
        forget_all(spark)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(df: DataFrame) -> None:
    """Delete what ``keep`` wrote for ``df``; only for tables that nothing reads any more."""
    path = getattr(df, "_tidemark_path", None)
    if path in _KEPT:
        _delete(df.sparkSession, path)
        _KEPT.remove(path)


def forget_all(spark: SparkSession) -> None:
    """Delete all that ``keep`` wrote in this process; results that read it must have been written before."""
    while _KEPT:
        _delete(spark, _KEPT.pop())


def bounded_batches(spark: SparkSession) -> None:
    """Bounds in bytes what a task hands to Python at once, unless the session has set its own."""
    for key, value in BATCH.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def named(name: str) -> Column:
    """The column of that very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def held(df: DataFrame, *names: str) -> Column:
    """The columns of ``df`` but ``names``, as one struct ``row_``: no internal name can clash with them."""
    return F.struct(*[named(c) for c in df.columns if c not in names]).alias("row_")


def unheld(df: DataFrame, *names: str) -> list[Column]:
    """What ``held(df, *names)`` holds, as columns again, to select from a table that has ``row_``."""
    return [F.col("row_").getField(c).alias(c) for c in df.columns if c not in names]


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns whose names an operator is about to add."""
    lower = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in lower])
