"""Conversion that pays for every request once: a content-addressed result cache.

A request is named by a hash of what the converter reads and of the converter's version.
Requests that the cache answers are not called; equal requests of one run are called once.
Results are appended to the cache by the tasks that made the calls and become visible task
by task, so a run that dies half-way keeps what its finished tasks paid for. Errors are
kept as a record of the run that met them; the next run calls them again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docpipe.operators.convert import RESULT_COLUMNS, RESULT_FIELDS, ConverterFactory, convert

CACHE_SCHEMA = T.StructType([T.StructField("request", T.StringType()), *RESULT_FIELDS, T.StructField("run", T.StringType())])
#: Files of finished tasks stay when the job fails; a repeated result is the same result.
TASK_COMMITS = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


def request_key(inputs: list[str], version: str) -> Column:
    """SHA-256 of the named columns' values, names and types apart from each other, and of the converter's version."""
    body = F.to_json(F.struct(*sorted(inputs)), {"ignoreNullFields": "false"})
    return F.sha2(F.concat(F.lit(f"{len(version)}:{version}"), body), 256)


def cached_results(spark: SparkSession, cache: str) -> DataFrame:
    """The cache's rows; a cache that was never written has none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache)


def successes(results: DataFrame) -> DataFrame:
    """One successful result per request: two runs at a time may both have called it."""
    found = F.struct(*[F.col(c) for c in RESULT_COLUMNS])
    return results.where("status = 'success'").groupBy("request").agg(F.min_by(found, "run").alias("r")).select("request", "r.*")


def pending(requests: DataFrame, results: DataFrame) -> DataFrame:
    """The distinct requests without a successful result."""
    return requests.join(results.where("status = 'success'").select("request").distinct(), "request", "left_anti")


def convert_resumable(df: DataFrame, make_converter: ConverterFactory, keep: list[str], inputs: list[str], cache: str,
                      version: str, partitions: int | None = None, call_rows: int = 1) -> DataFrame:
    """``convert`` with a cache: the ``keep`` columns, status, markdown, error, error_type, processing_time and ``cached``.

    Every input row comes back once. ``inputs`` are all that the converter reads, so rows that
    agree in them share a call and its result; ``cached`` says that the result was there
    before this run. ``version`` names the converter and its settings: another version
    starts afresh. ``cache`` is a folder that every executor reaches. Calls are made here,
    not when the result is read.

    Null inputs are values like others; an empty ``df`` makes no call. With ``partitions``
    the pending requests are spread over that many tasks; fewer rows per task mean less to
    pay again if a task dies, as results are kept per finished task.
    """
    spark = df.sparkSession
    keyed = df.withColumn("request", request_key(inputs, version))
    before = successes(cached_results(spark, cache))
    asked = keyed.groupBy("request").agg(*[F.first(c).alias(c) for c in inputs])
    todo = pending(asked, cached_results(spark, cache))
    run = uuid.uuid4().hex
    called = convert(todo, make_converter, ["request"], inputs, partitions, call_rows)
    called.withColumn("run", F.lit(run)).write.mode("append").options(**TASK_COMMITS).parquet(cache)

    now = cached_results(spark, cache).where(F.col("run") == run)
    found = before.withColumn("cached", F.lit(True)).unionByName(
        now.drop("run").join(before.select("request"), "request", "left_anti").withColumn("cached", F.lit(False)))
    return keyed.select(*keep, "request").join(found, "request", "left").select(*keep, *RESULT_COLUMNS, "cached")
