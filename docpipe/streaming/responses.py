"""Continuous cleaning of arriving converter answers.

The cleaner is a narrow projection (see ``docpipe.functions.cleaning``), so it runs on a
stream as is: no ``foreachBatch``, no state. Chunk results arriving one by one are
cleaned the same way; stitching them is a batch step once a parent job is complete.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docpipe.functions.cleaning import clean_response
from docpipe.schemas import RESPONSES_SCHEMA


def read_responses(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(RESPONSES_SCHEMA).format(fmt).load(path)


def cleaned_responses(responses: DataFrame, remove_page_markers: bool = False) -> DataFrame:
    """doc_id, markdown: the cleaned text of each arriving answer."""
    return responses.select("doc_id", clean_response("content", remove_page_markers).alias("markdown"))


def start_cleaning(spark: SparkSession, source: str, sink: str, checkpoint: str,
                   available_now: bool = False) -> StreamingQuery:
    """Clean every answer file that lands in ``source`` into a Parquet table at ``sink``.

    The file sink commits each micro-batch atomically and the checkpoint makes the query
    restartable, so an executor or driver loss neither loses nor duplicates rows.
    """
    writer = (cleaned_responses(read_responses(spark, source)).writeStream
              .format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
              .outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def chunk_columns() -> list[str]:
    """The columns of chunk results, in the order of their files."""
    from docpipe.schemas import CHUNK_RESULTS_SCHEMA
    return CHUNK_RESULTS_SCHEMA.names


def read_chunk_results(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    from docpipe.schemas import CHUNK_RESULTS_SCHEMA
    return spark.readStream.schema(CHUNK_RESULTS_SCHEMA).format(fmt).load(path)


def start_chunk_collection(spark: SparkSession, source: str, table_path: str, checkpoint: str,
                           available_now: bool = False) -> StreamingQuery:
    """Append chunk results to a table as they arrive.

    This replaces a working file rewritten after every chunk: each micro-batch is one
    atomic append, the checkpoint makes the collection restartable, and the stitched,
    cleaned document is a batch step over the table (``operators.chunks.stitch_chunks``)
    once a parent job has all its chunks (see ``start_parent_completion``).
    """
    writer = (read_chunk_results(spark, source).writeStream.format("parquet")
              .option("path", table_path).option("checkpointLocation", checkpoint).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def complete_parents(results: DataFrame) -> DataFrame:
    """Documents (and prompt variants, where ``approach`` is given) whose every chunk has arrived.

    The batch view: a count of chunk numbers = total_chunks over the whole table. Keyed by
    document, never by parent job id: those are labels that two documents may share."""
    keys = ["doc_id", *(["approach"] if "approach" in results.columns else [])]
    return (results.where("chunk_number BETWEEN 1 AND total_chunks").groupBy(*keys)
            .agg(F.countDistinct("chunk_number").alias("n"), F.max("total_chunks").alias("total"))
            .where(F.col("n") == F.col("total")).select(*keys))


class ParentCompletion(StatefulProcessor):
    """State of one parent: ``seen`` (the chunk numbers that have come) and ``parent`` (their total, and whether it was told).

    Both expire ``retention_ms`` after they were last written.
    """

    def __init__(self, retention_ms: int):
        self.retention_ms = retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getListState("seen", "chunk_number int", ttlDurationMs=self.retention_ms)
        self.parent = handle.getValueState("parent", "total_chunks int, told boolean", ttlDurationMs=self.retention_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total, told = self.parent.get() or (0, False)
        come: set[int] = set()
        for pdf in rows:
            given = pdf.dropna(subset=["chunk_number", "total_chunks"])
            if len(given):
                come.update(given["chunk_number"].astype(int))
                total = max(total, int(given["total_chunks"].max()))
        if told:                            # a repeated chunk of a finished parent
            self.parent.update((total, True))
            return
        seen = {n for n, in self.seen.get()}
        new = sorted(come - seen)
        seen.update(new)
        if total > 0 and sum(1 <= n <= total for n in seen) == total:
            self.seen.clear()
            self.parent.update((total, True))
            yield pd.DataFrame({"doc_id": [key[0]], "approach": [key[1] or None], "total_chunks": [total]})
        else:
            if new:
                self.seen.appendList([(n,) for n in new])
            self.parent.update((total, False))

    def close(self) -> None:
        pass


def completed_parents(results: DataFrame, retention_seconds: int = 7 * 86400) -> DataFrame:
    """doc_id, approach, total_chunks of each parent, once, when its last chunk arrives (output mode ``append``).

    ``results``: a stream of chunk results. Chunks may come late, repeated and in any order; a
    failed chunk counts as come. A parent that gets no chunk for ``retention_seconds`` (of
    processing time) is forgotten. State grows with the chunk numbers of unfinished parents
    only; the result table is never read again. Needs the RocksDB state store.
    """
    rows = results.where("doc_id IS NOT NULL").select(
        "doc_id", F.coalesce("approach", F.lit("")).alias("approach"), "chunk_number", "total_chunks")
    return rows.groupBy("doc_id", "approach").transformWithStateInPandas(
        ParentCompletion(retention_seconds * 1000), "doc_id long, approach string, total_chunks int", "append", "ProcessingTime")


def start_parent_completion(spark: SparkSession, source: str, sink: str, checkpoint: str, available_now: bool = False,
                            retention_seconds: int = 7 * 86400) -> StreamingQuery:
    """Write each parent to the table at ``sink`` when its last chunk lands in ``source``.

    The batch stitch then reads only the documents named there. With ``available_now`` one
    micro-batch takes all that is there: state that expires in processing time keeps
    ``availableNow`` going, as there is always a later time to clean up for.
    """
    writer = (completed_parents(read_chunk_results(spark, source), retention_seconds).writeStream.format("parquet")
              .option("path", sink).option("checkpointLocation", checkpoint).outputMode("append"))
    writer = writer.trigger(once=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
