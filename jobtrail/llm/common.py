"""What the training-data operators share: table reading, the shared folder, Arrow helpers.

Every operator takes DataFrames and selects only the columns it names, so extra
columns (also ones whose names clash with result columns) never matter.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch; both bound a Python worker's memory.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which the driver and all executors see.

    Where it is unset on one machine, as in tests, a folder of the warehouse is used; a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors reach")
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints").rstrip("/")


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder as a URI, by the cluster's own default file system where it names none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"file://{whole[5:]}" if whole.startswith("file:/") and not whole.startswith("file://") else whole


def store(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back. Survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def drop(*stored: DataFrame) -> None:
    """Delete tables made by store() that no later plan reads."""
    for df in stored:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let go of what finished queries left on the driver; their broadcasts and cached rows go with it."""
    gc.collect()
    spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def deal(df: DataFrame, values: list[int], column: str) -> DataFrame:
    """df repartitioned by an int column that has these values, a partition for each of them."""
    spark, n = df.sparkSession, len(values)
    # numbers whose hashes fall into different partitions
    places = spark.range(64 * n + 64).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id")).orderBy("p").collect()  # n rows
    own = dict(zip(values, [r.id for r in places]))
    key = F.element_at(F.create_map(*(F.lit(x) for pair in own.items() for x in pair)), F.col(column)) if len(own) == n else F.col(column).cast("long")
    return df.withColumn("dealt_by", key).repartition(n, "dealt_by").drop("dealt_by")


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 3 is 1: rows no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3, F.lit(0)) == 1


def sampled_labels(labels: DataFrame, label: Column, most: int) -> DataFrame:
    """(doc_id, label) of rows not held out, about `most` of them if there are more.

    The sample is taken by a hash of doc_id, so each task takes its own share, and its size
    is bounded: it can be broadcast.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = rows.groupBy("doc_id").agg(label.cast("int").alias("label")).where("label is not null")
    n = known.count()
    return known if n <= most else known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(most / n * (1 << 30)))


def map_batches(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], list]]) -> DataFrame:
    """mapInArrow with a per-task setup: make() returns f(batch) -> columns in the order of schema."""
    fields = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            columns = f(batch)
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, t.type) for c, t in zip(columns, arrow)],
                schema=arrow,
            )

    return df.mapInArrow(run, fields)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]
