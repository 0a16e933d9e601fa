"""Tables in the shared folder, which cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_registered: list = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, a new folder of this machine, and an error on a cluster."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def materialize(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` once to the shared folder, in a folder for each value of ``by``, and read it back; removed by release(), or when Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skein/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    if not _registered:
        _registered.append(atexit.register(_clean))
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """A mark for release()."""
    return len(_written)


def release(mark: int) -> None:
    """Remove all tables written since ``mark`` but the last one; what was made of them must be stored in that."""
    for spark, path in _written[mark:-1]:
        _remove(spark, path)
    del _written[mark:-1]


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the session may be gone already
            return
