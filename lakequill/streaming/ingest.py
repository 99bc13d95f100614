"""An append-only log as a stream: each micro-batch adds the rows whose key is not done yet. Restarts lose and repeat nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lakequill.operators.latest import last_wins


def read_log_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def ingest(stream: DataFrame, target: str, checkpoint: str, keys: list[str], seq: str, config_hash: str) -> StreamingQuery:
    """Good rows of the current configuration, one for each key: the first batch that has a key settles it."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        good = last_wins(batch.where((F.col("config_hash") == config_hash) & F.col("error").isNull()), keys, seq)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            good = good.join(spark.read.parquet(target).select(*keys), keys, "left_anti")
        good.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_rates(stream: DataFrame, ts: str, arm: str, flag: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Successes and trials by arm and window; rows later than the watermark are left out."""
    out = stream.withWatermark(ts, late).groupBy(F.window(ts, window), arm)
    return out.agg(F.sum(F.col(flag).cast("int")).alias("successes"), F.count("*").alias("trials"))
