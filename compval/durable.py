"""Tables that outlive the job that made them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir. Only a local session without that setting gets a temporary one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not found:
        jdir = sc._jsc.sc().getCheckpointDir()
        found = jdir.get() if jdir.isDefined() else None
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        found = _LOCAL.get(sc.applicationId) or _LOCAL.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="compval-"))
    return f"{found.rstrip('/')}/tables-{sc.applicationId}/{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df, written as a table and read back: computed once, its lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes a table of saved() that no later step reads."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tables-" in path:
            path = jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(conf).delete(path, True)


class Journal:
    """Texts by number in a folder that outlives its application. A text is written under another name and then renamed, so
    one that is found is whole; the two last are kept."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.path = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.path)

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.path, name)

    def _names(self) -> list[str]:
        return sorted(n for f in self.fs.listStatus(self.path) if (n := f.getPath().getName()).endswith(".json"))

    def write(self, number: int, text: str) -> None:
        name, part = f"{number:010}.json", self._at(f"{number:010}.part")
        out = self.fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        self.fs.delete(self._at(name), False)
        if not self.fs.rename(part, self._at(name)):
            raise OSError(f"{name} was not written")
        for old in self._names()[:-2]:
            self.fs.delete(self._at(old), False)

    def last(self) -> str | None:
        names = self._names()
        if not names:
            return None
        found = self.fs.open(self._at(names[-1]))
        try:
            return bytes(found.readAllBytes()).decode()
        finally:
            found.close()
