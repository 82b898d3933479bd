"""Structured Streaming versions of the monitor and window operators."""

from __future__ import annotations

from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridspark.functions.names import RUN_IN_PATH, run_of_path
from gridspark.functions.scalars import last_number
from gridspark.operators.monitor import METRIC_PATTERN, metrics
from gridspark.operators.timewin import window_average
from gridspark.sources.shared import fresh_path
from gridspark.sources.text import split_order


def log_stream(spark: SparkSession, path: str, files_per_batch: int | None = None,
               run_in_path: str = RUN_IN_PATH, by: str = "name") -> DataFrame:
    """Lines of log folders in which files arrive, as a stream, with their run and file split.

    For files that grow, see ``sources.tail``.
    """
    reader = spark.readStream.format("text").option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path).select(
        run_of_path("_metadata.file_path", run_in_path).alias("run"), "value",
        F.struct(*split_order(by)).alias("split"),
    )


def _data_files(spark: SparkSession, path: str) -> list:
    """Status of a folder's data files, by path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found, out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(where, True), []
    while found.hasNext():
        out.append(found.next())
    return sorted((f for f in out if f.getPath().getName().startswith("part-")), key=lambda f: f.getPath().toString())


def write_arrivals(rows: DataFrame, path: str, at: str, files: int) -> None:
    """Write ``rows`` as ``files`` files that follow each other in ``at``, dated in that order, so that a stream reads them in it."""
    spark = rows.sparkSession
    rows.repartitionByRange(files, at).write.parquet(path)
    written = _data_files(spark, path)
    for n, file in enumerate(written):
        store = file.getPath().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        store.setTimes(file.getPath(), written[0].getModificationTime() - 1000 * (len(written) - n), -1)


def arrivals(spark: SparkSession, path: str, schema: str, files_per_batch: int) -> DataFrame:
    """Folders of ``write_arrivals`` as a stream in batches of a few files, so that a watermark can clear state between them.

    Where the store did not keep the files' dates all is one batch: rows would else come late and be dropped.
    """
    dates = [f.getModificationTime() for f in _data_files(spark, path)]
    reader = spark.readStream.schema(schema)
    if all(a < b for a, b in zip(dates, dates[1:])):
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path}/*")


def live_metrics(lines: DataFrame) -> DataFrame:
    """Latest value per run and metric of a line stream that carries an order (use update output)."""
    found = lines.withColumn("metric", F.regexp_extract("value", METRIC_PATTERN, 1)).where(F.col("metric") != "")
    return found.groupBy("run", "metric").agg(F.max_by(last_number("value"), "ord").alias("value"))


def streaming_average(rows: DataFrame, keys: list[str], fields: list[str], period: float, phase: float = 0.0,
                      delay: str = "2 hours", ts: str = "ts") -> DataFrame:
    """Windowed means of a stream; rows later than ``delay`` are dropped, closed windows are appended."""
    return window_average(rows.withWatermark(ts, delay), keys, fields, period, phase, ts)


def drop_repeats(rows: DataFrame, keys: list[str], delay: str = "2 hours", ts: str = "ts") -> DataFrame:
    """First of the rows repeated by overlapping restarts, remembered for the watermark delay."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


@contextmanager
def only_with_data(spark: SparkSession):
    """Queries started inside run no empty batches.

    State with processing-time timeouts asks for one batch after the other, so that a query that is to
    end when its input does would never end; its timeouts come due with the next data.
    """
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drain(stream: DataFrame, label: str, mode: str = "append", limited: bool = False,
          timeouts: bool = False) -> DataFrame:
    """Process all input available now into a table in the shared folder and read it back.

    ``limited`` is for sources that hand out their input in parts of a limited size, ``timeouts`` for
    state with processing-time timeouts.  Complete and update output go through ``foreachBatch``; each batch lands in its own
    ``batch=<n>`` folder, overwritten on replay, so a retried batch leaves no duplicates.
    """
    spark = stream.sparkSession
    path, checkpoint = fresh_path(spark, label), fresh_path(spark, f"{label}-checkpoint")
    writer = stream.writeStream.option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime="0 seconds") if limited else writer.trigger(availableNow=True)
    schema = stream.schema
    if mode == "append":
        writer = writer.outputMode("append").format("parquet").option("path", path)
    else:
        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

        writer, schema = writer.outputMode(mode).foreachBatch(keep), schema.add("batch", "long")
    with only_with_data(spark) if timeouts else nullcontext():
        query = writer.start()
    if limited:
        query.processAllAvailable()
        query.stop()
    else:
        query.awaitTermination()
    return spark.read.schema(schema).parquet(path)


def watch_log_files(lines: DataFrame, label: str) -> DataFrame:
    """Latest value per run and metric, with its ``ord``, of every micro-batch of a ``log_stream``.

    Line order inside a file split is only known to the batch that reads it, so each
    batch reduces its own lines.  Files may arrive in any order: ``monitor.latest`` over
    the batches picks the value that is last by file and place.
    """
    spark = lines.sparkSession
    path, checkpoint = fresh_path(spark, label), fresh_path(spark, f"{label}-checkpoint")

    def reduce_batch(batch: DataFrame, number: int) -> None:
        order = F.struct("split", F.monotonically_increasing_id().alias("seq"))
        last = metrics(batch.withColumn("ord", order)).groupBy("run", "metric").agg(
            F.max_by("value", "ord").alias("value"), F.max("ord").alias("ord"))
        last.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = (
        lines.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(reduce_batch).start()
    )
    query.awaitTermination()
    split = lines.schema["split"].dataType.simpleString()
    return spark.read.schema(f"run string, metric string, value double, ord struct<split:{split},seq:bigint>, batch bigint").parquet(path)


def latest_batch_per_key(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Current state from update-mode batches: each key's row of the highest batch."""
    values = [c for c in updates.columns if c not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("s")).select(*keys, "s.*")
