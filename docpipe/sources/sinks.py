"""Result sinks: Markdown documents and metadata records.

Outputs are tables, written with Spark's committers (atomic per job), instead of one file
per document on a local disk. ``output_name`` keeps the original naming so that a file
per document can still be exported from the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_markdown(results: DataFrame, path: str, mode: str = "append",
                   partition_by: list[str] | None = None) -> None:
    """doc_id, approach, job_id, output_name, markdown -> Parquet table."""
    cols = [c for c in ["doc_id", "approach", "job_id", "unique_job_id", "output_name", "markdown"] if c in results.columns]
    writer = results.select(*cols).write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def metadata_records(metadata: DataFrame) -> DataFrame:
    """One nested record per run, in the shape of the metadata JSON file."""
    return metadata.select(
        "doc_id",
        F.struct(
            F.col("source_pdf"), F.col("output_markdown"), F.col("processing_date"), F.col("job_id"), F.col("unique_job_id"),
            F.col("pages_processed"),
            F.struct(F.col("optimization_performed").alias("performed"), F.col("size_reduction"),
                     F.col("images_removed")).alias("optimization"),
            F.struct(F.col("optimization_seconds").alias("optimization"), F.col("ocr_seconds").alias("ocr"),
                     F.col("total_seconds").alias("total")).alias("processing_time"),
            F.col("model"), F.col("approach"), F.col("prompt_length"), F.col("custom_prompt_file"), F.col("status"),
            F.col("markdown_length"), F.col("error"), F.col("error_type"), F.col("failed_at"),
        ).alias("metadata"))


def write_metadata(metadata: DataFrame, path: str, mode: str = "append") -> None:
    """Metadata of successful and failed runs as JSON lines."""
    metadata_records(metadata).select("metadata.*").write.mode(mode).json(path)
