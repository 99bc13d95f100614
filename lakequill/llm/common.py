"""What the operators of this subpackage share: input tables, shared scratch tables, Arrow batching."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes that one Arrow batch may hold on its way to a Python worker; texts can be long.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares (spark.checkpoint.dir). Where that is unset, a folder of its own in local mode, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lakequill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def show_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, if they can't find it elsewhere."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)


class Store:
    """Tables written to the shared folder. They cut lineage, and survive the loss of any executor."""

    def __init__(self, spark: SparkSession, label: str):
        bound_batches(spark)
        show_package(spark)
        self.spark, self.root, self.count = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_: object) -> None:
        self.clear()

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def save(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        """df written and read again, in folders by the columns `by`."""
        path = self.path(name)
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def free_shuffles(self) -> None:
        """Let Spark's cleaner remove the shuffle files of plans that are done; it acts when the driver collects garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing reads any more."""
        for t in tables:
            for folder in {f.rpartition("/")[0] for f in t.inputFiles()}:
                if self.root.split("://")[-1] in folder:
                    self.delete(folder)

    def clear(self) -> None:
        """Remove all that was written, once the results that read it have been consumed. `with Store(...)` does so at its end."""
        self.delete(self.root)

    def delete(self, folder: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class FileWriter:
    """Appends to files of a folder that all executors share, and starts a new file when one is full.

    Names are 60 random bits, given as a number: what a lost task wrote is never read, as only returned names are known.
    """

    def __init__(self, folder: str, suffix: str, limit: int = 256 << 20):
        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.suffix, self.limit, self.out, self.id, self.at = suffix, limit, None, 0, 0

    def write(self, data: bytes) -> tuple[int, int, int]:
        """File, offset and length."""
        if self.out is None or self.at and self.at + len(data) > self.limit:
            self.close()
            self.id, self.at = uuid.uuid4().int >> 68, 0
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.id:015x}.{self.suffix}", compression=None)
        self.out.write(data)
        self.at += len(data)
        return self.id, self.at - len(data), len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


class RangeReader:
    """Reads ranges of files that a FileWriter wrote; the last `most` files stay open."""

    def __init__(self, folder: str, suffix: str, most: int = 64):
        (self.fs, self.folder), self.suffix, self.most, self.files = fs.FileSystem.from_uri(folder), suffix, most, {}

    def read(self, file: int, offset: int, length: int) -> bytes:
        held = self.files.pop(file, None) or self.fs.open_input_file(f"{self.folder}/{file:015x}.{self.suffix}")
        self.files[file] = held
        if len(self.files) > self.most:
            self.files.pop(next(iter(self.files))).close()
        return held.read_at(length, offset)

    def whole(self, file: int) -> bytes:
        return self.read(file, 0, self.fs.get_file_info(f"{self.folder}/{file:015x}.{self.suffix}").size)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose `column` holds about `limit` bytes at most, one row at least."""
    for b in batches:
        if b.num_rows and b.column(column).nbytes > limit and b.num_rows > 1:
            step = max(1, b.num_rows * limit // b.column(column).nbytes)
            for i in range(0, b.num_rows, step):
                yield b.slice(i, step)
        elif b.num_rows:
            yield b
