"""Writers: appends, outboxes, upserts by id and versioned tables with one-step commits."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def outbox(df: DataFrame, root: str, channel: str = "destination") -> None:
    """One folder per channel; delivery to a service is another process's work."""
    df.write.mode("append").partitionBy(channel).parquet(root)


def append_new(df: DataFrame, stored: DataFrame, path: str, key: str = "id") -> None:
    """Append rows whose key isn't stored yet; of rows with one key one is written."""
    df.dropDuplicates([key]).join(stored.select(key), key, "left_anti").write.mode("append").parquet(path)


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last written row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def write_json_array(df: DataFrame, path: str, order: str | None = None) -> None:
    """One file that holds a JSON array of the rows, indented by two, in UTF-8. Rows pass through the driver a partition at a
    time; the file appears under its name when it is whole. For results and exports; tables are stored as Parquet."""
    spark = df.sparkSession
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(new, True)
    lead = "["
    for r in (df.orderBy(order) if order else df).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator():
        body = json.dumps(json.loads(r.j), ensure_ascii=False, indent=2)
        out.write(bytearray((lead + "\n  " + body.replace("\n", "\n  ")).encode()))
        lead = ","
    out.write(bytearray(("[]" if lead == "[" else "\n]").encode()))
    out.close()
    replace(spark, new, to)


def write_manifest(manifest: DataFrame, output: str) -> str:
    """The one row of a run's summary as JSON beside its output, under a name made of the output's stem; returns the path."""
    folder, _, name = output.rstrip("/").rpartition("/")
    path = f"{folder}/{name.rpartition('.')[0] or name}_manifest.json"
    row = manifest.select(F.to_json(F.struct(*manifest.columns), {"ignoreNullFields": "false"})).first()[0]
    spark = manifest.sparkSession
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(new, True)
    out.write(bytearray(json.dumps(json.loads(row), ensure_ascii=False, indent=2).encode()))
    out.close()
    replace(spark, new, to)
    return path


def replace(spark: SparkSession, new, to) -> None:
    """Rename a file over another in one step, by the file system's own overwriting rename."""
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri() if to.toUri().getScheme() else jvm.java.net.URI.create("file:///"), spark.sparkContext._jsc.hadoopConfiguration())
    option = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    option[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(new, to, option)


class Versioned:
    """A table whose versions are written beside each other. A version is current once its numbered pointer file exists;
    no step removes the pointer of the version before, so a reader always finds a whole table and a failure in
    between leaves the last one."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _number(self) -> int:
        fs = self._fs()
        if not fs.exists(self._path("pointers")):
            return 0
        names = [f.getPath().getName() for f in fs.listStatus(self._path("pointers"))]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def current(self) -> str | None:
        """Folder of the current version."""
        n = self._number()
        return f"{self.root}/{self.spark.read.text(f'{self.root}/pointers/{n:012d}').first()[0]}" if n else None

    def read(self, schema) -> DataFrame:
        at = self.current()
        return self.spark.read.schema(schema).parquet(at) if at else self.spark.createDataFrame([], schema)

    def write(self, df: DataFrame) -> None:
        """Two writers of the same number: the second's rename finds the pointer there and fails."""
        name = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}")
        self._point(name, self._number() + 1)

    def _point(self, name: str, number: int) -> None:
        fs, new, to = self._fs(), self._path(f"pointers/.{name}"), self._path(f"pointers/{number:012d}")
        out = fs.create(new, True)
        out.write(bytearray(name.encode()))
        out.close()
        if fs.exists(to) or not fs.rename(new, to):
            raise RuntimeError(f"version {number} of {self.root} was written by someone else")
