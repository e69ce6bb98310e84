"""Session helpers: a tuned local session, the shared scratch folder and lineage cuts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}
#: Folders that `stored` has written, in order.
_FOLDERS: list[tuple[SparkSession, str]] = []


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "4g", **conf: str) -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("isoloom")
    settings = LOCAL_CONF | {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares: `spark.checkpoint.dir`, or a local one where it is unset."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = os.path.join(tempfile.gettempdir(), "checkpoints")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which outlives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table that is read more than once to the shared folder and read it back.

    Its folder goes when the process ends or `discard` is called.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/isoloom-{label}-{uuid.uuid4().hex}"
    _FOLDERS.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def folders() -> int:
    """How many folders `stored` has written so far: where `discard` can begin."""
    return len(_FOLDERS)


def discard(since: int = 0, keep: Iterable[int] = ()) -> None:
    """Delete the folders written since then, but for those whose numbers are kept. Tables read from them are gone."""
    kept = set(keep)
    for i in range(since, len(_FOLDERS)):
        spark, path = _FOLDERS[i]
        if i not in kept and path:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            _FOLDERS[i] = (spark, "")


@atexit.register
def _discard_at_end() -> None:
    try:
        discard()
    except Exception:  # the session may have ended before
        pass
