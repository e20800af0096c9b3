"""Tables the operators read and the intermediate tables they write into the cluster's shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfield.session import work_folder

#: Bytes at which a batch that goes to Python ends. Steps that hand on whole texts take the smaller: the JVM and Python hold several copies of a batch at once.
ARROW_BYTES, TEXT_BYTES = str(8 << 20), str(2 << 20)


#: Whether a query's shuffle files go at its end.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: What an operator does with the batches of a task.
Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def giving_back(run: Task) -> Task:
    """``run``, after which freed memory goes back to the system: Python workers outlive their task, and those of all steps share an executor's memory."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)

    return task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def end_batches(spark: SparkSession, size: str) -> None:
    """Batches that go to Python end by bytes as well as by rows: texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


class Workspace:
    """A new folder of one job's intermediate tables. Each is written once and then read, so that a lost executor costs only a reread."""

    def __init__(self, spark: SparkSession, batch_bytes: str = ARROW_BYTES):
        self.spark, self.batch_bytes = spark, batch_bytes
        self.folder = work_folder(spark)
        end_batches(spark, batch_bytes)

    def save(self, df: DataFrame, name: str, *, by: str | None = None, free: bool = False) -> DataFrame:
        """free: the shuffle files behind the table go as soon as it is written, not when the driver happens to collect garbage."""
        end_batches(self.spark, self.batch_bytes)
        writer = df.write.mode("overwrite").option("compression", "zstd")
        before = self.spark.conf.get(FREE_SHUFFLES, "false")
        try:
            if free:
                self.spark.conf.set(FREE_SHUFFLES, "true")
            (writer.partitionBy(by) if by else writer).parquet(f"{self.folder}/{name}")
        finally:
            self.spark.conf.set(FREE_SHUFFLES, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def unit_draw(*parts: Column) -> Column:
    """A number in (0, 1) that the texts of ``parts`` decide: the first 52 bits of their MD5."""
    digest = F.md5(F.concat_ws("/", *[p.cast("string") for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def with_schema(docs: DataFrame, ddl: str, *, carry: bool | list[str]) -> T.StructType:
    """Output schema of an operator; carry: with the whole input row, or the named columns of it, as the struct ``row``."""
    out = T.StructType.fromDDL(ddl)
    return out.add("row", (docs if carry is True else docs.select(*carry)).schema) if carry else out


def picked(docs: DataFrame, id_col: str, text_col: str, *, carry: bool | list[str], once: bool = False) -> DataFrame:
    """doc_id, text, and the row, or the named columns of it, where it is carried along; names of other columns never clash with these.

    once: of a whole row that is carried along the text is not sent a second time; ``with_texts`` takes it from the row.
    """
    if once and carry is True:
        return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.struct("*").alias("row"))
    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    return docs.select(*columns, *([F.struct(*(["*"] if carry is True else carry)).alias("row")] if carry else []))


def with_texts(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, row) as (doc_id, text, row); nothing is copied where the text is a string."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).field(text_col).cast(pa.string()), b.column(1)], names=["doc_id", "text", "row"])
