"""What the operators of this subpackage share: input rows, the shared folder, tables written there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_hash(text: str = "text") -> Column:
    """64 bits that tell apart the texts of rows that share an id, or have none."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def documents(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id (long, null where it is), text (empty for null) and what more is asked for; all other columns are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session without that setting gets a temporary folder of its own: on
    a cluster executors would write to folders that nothing else sees."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not found:
        jdir = sc._jsc.sc().getCheckpointDir()
        found = jdir.get() if jdir.isDefined() else None
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        found = _LOCAL.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="compval-"))
    return found.rstrip("/")


_LOCAL: dict[str, str] = {}


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as a table in the shared folder and read back: its lineage ends there and outlives executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Deletes a table of written() that no later step reads."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/llm-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def spare(df: DataFrame, name: str) -> str:
    """name, longer where df has a column of that name."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def rows_out(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about most_bytes at most, one row at least."""
    for b in batches:
        step = max(1, int(b.num_rows * most_bytes / max(b.nbytes, 1)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def map_text(df: DataFrame, change: Callable[[str, object], str], given: str) -> DataFrame:
    """df with change(text, given) for its text, without the column `given`; null texts stay."""
    keep = [c for c in df.columns if c != given]
    schema = df.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            at, arg = b.schema.get_field_index("text"), b.column(b.schema.get_field_index(given)).to_pylist()
            new = [t if t is None else change(t, a) for t, a in zip(b.column(at).to_pylist(), arg)]
            cols = {c: pa.array(new, pa.string()) if c == "text" else b.column(b.schema.get_field_index(c)) for c in keep}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return df.mapInArrow(run, schema)
