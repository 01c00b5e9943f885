"""The event stream: windowed edge counts with late data, and incremental tables with a resume ledger."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from palaver.sources.writers import undone


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events as a stream of a folder or one file; the schema is read from what is there, times without a zone are taken in the session's."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        folder, _, name = path.rpartition("/")  # a stream watches folders
        reader, path = reader.option("pathGlobFilter", name), folder
    stream = reader.parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, *, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, event_type) -> n, total per tumbling window; events later than ``late`` behind the newest are dropped."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", size), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "total")
    )


def append_once(stream: DataFrame, target: str, ledger: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Append rows to ``target`` whose key ``ledger`` does not list, and list them; a repeated batch adds nothing.

    Rows and ledger are one table per batch number, so a batch that is run again
    overwrites what it wrote.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        df = df.dropDuplicates(keys)
        try:
            before = spark.read.parquet(ledger).where(F.col("batch") < number)
            df = undone(df, before, keys)
        except Exception as e:  # no ledger yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
        df.persist()
        df.write.mode("overwrite").parquet(f"{target}/batch={number}")
        df.select(*keys).write.mode("overwrite").parquet(f"{ledger}/batch={number}")
        df.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_end(df: DataFrame, keys: list[str], folder: str, checkpoint: str) -> DataFrame:
    """Process all that is there and return the latest row of each key, from files below ``folder``.

    Every batch writes the rows it changed as a table of its own under its number,
    so one that is run again overwrites what it wrote and a restart goes on from
    ``checkpoint``, a folder that all executors share.  Nothing passes the driver.
    Late rows are dropped by the watermark of ``df``.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    df.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    spark = df.sparkSession
    try:
        all_ = spark.read.option("basePath", folder).schema(StructType([*df.schema, StructField("batch", LongType())])).parquet(folder)
        all_.take(1)
    except Exception as e:  # no batch has had rows
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], df.schema)
    rest = [c for c in df.columns if c not in keys]
    newest = all_.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return newest.select(*keys, "r.*").select(*df.columns)
