"""Conversion step: a caller-supplied converter run over a DataFrame, with a fallback route.

The converter is the one place where per-document Python is unavoidable: it calls a remote
service (or any other engine) that turns a document and a prompt into Markdown. It runs
in ``mapInPandas`` on Arrow batches, is created once per partition, and never fails a
task because of one document: an exception becomes an error row. Everything around it —
routing, retries, chunking, stitching, cleaning — stays in DataFrame expressions.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A converter receives a pandas batch of input rows and returns, aligned with it row by row,
# columns status ('success' | 'error'), markdown, error, error_type, processing_time. Each
# row is handed to a converter once: if the call raises, every row of that call gets status
# 'exception' and nothing is sent again, so a converter whose calls cost money takes one
# row a call (the default) or returns errors instead of raising them.
Converter = Callable[[pd.DataFrame], pd.DataFrame]
ConverterFactory = Callable[[], Converter]

RESULT_FIELDS = [
    T.StructField("status", T.StringType()),
    T.StructField("markdown", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("error_type", T.StringType()),
    T.StructField("processing_time", T.DoubleType()),
]
RESULT_COLUMNS = [f.name for f in RESULT_FIELDS]
STATUSES = ("success", "error", "exception")


def _error_frame(n: int, error: str, error_type: str, seconds: float) -> pd.DataFrame:
    """Rows of a converter call that raised: status ``exception`` (a returned error is ``error``)."""
    return pd.DataFrame({"status": ["exception"] * n, "markdown": [None] * n, "error": [error] * n,
                         "error_type": [error_type] * n, "processing_time": [seconds / n] * n})


def _run_call(convert: Converter, rows: pd.DataFrame) -> pd.DataFrame:
    """One converter call as aligned result rows, whatever comes back."""
    start = time.monotonic()
    try:
        out = convert(rows)[RESULT_COLUMNS].reset_index(drop=True)
    except Exception as exc:  # noqa: BLE001 - errors are data here
        return _error_frame(len(rows), str(exc), type(exc).__name__, time.monotonic() - start)
    if len(out) != len(rows):
        message = f"the converter returned {len(out)} rows for {len(rows)}"
        return _error_frame(len(rows), message, "ConverterContractError", time.monotonic() - start)
    unknown = ~out["status"].isin(STATUSES)
    if unknown.any():
        out.loc[unknown, "error"] = "the converter returned no status it may"
        out.loc[unknown, "error_type"] = "ConverterContractError"
        out.loc[unknown, ["status", "markdown"]] = ["exception", None]
    return out


def convert(df: DataFrame, make_converter: ConverterFactory, keep: list[str],
            inputs: list[str] | None = None, partitions: int | None = None, call_rows: int = 1) -> DataFrame:
    """Run the converter over ``df``; output = ``keep`` columns + status, markdown, error,
    error_type, processing_time. Every input row comes back exactly once.

    ``inputs`` are the columns the converter reads (default: all). ``partitions``
    optionally re-spreads the rows first so that slow remote calls run on many tasks.
    ``call_rows`` rows go into one call.
    """
    cols = list(dict.fromkeys(keep + (inputs or [c for c in df.columns if c not in keep])))
    src = df.select(*cols)
    if partitions:
        src = src.repartition(partitions)
    keep_fields = [f for f in src.schema.fields if f.name in keep]
    schema = T.StructType(keep_fields + RESULT_FIELDS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        converter = make_converter()           # one client per partition
        for batch in batches:
            for at in range(0, len(batch), call_rows):
                rows = batch.iloc[at:at + call_rows].reset_index(drop=True)
                yield pd.concat([rows[[f.name for f in keep_fields]], _run_call(converter, rows)], axis=1)

    return src.mapInPandas(run, schema)


def retried(failed: DataFrame, inputs: DataFrame, fallback: ConverterFactory, keys: list[str],
            read: list[str], call_rows: int = 1) -> DataFrame:
    """Fallback calls for failed first attempts.

    ``failed``: the keys, error, error_type, status and processing_time of the first attempt;
    ``inputs``: the keys and what the converter reads. A fallback that works gives its text
    as it is and the time of both attempts; one that fails leaves the first attempt's error.
    """
    again = inputs.join(failed.select(*keys), keys, "left_semi")
    second = convert(again, fallback, keys, read, call_rows=call_rows).select(
        *keys, F.col("status").alias("_status"), F.col("markdown").alias("_markdown"),
        F.col("processing_time").alias("_seconds"))
    worked = F.col("_status") == "success"
    return failed.join(second, keys, "left").select(
        *keys, F.when(worked, "success").otherwise(F.col("status")).alias("status"),
        F.when(worked, F.col("_markdown")).alias("markdown"),
        F.when(~F.coalesce(worked, F.lit(False)), F.col("error")).alias("error"),
        F.when(~F.coalesce(worked, F.lit(False)), F.col("error_type")).alias("error_type"),
        (F.col("processing_time") + F.coalesce("_seconds", F.lit(0.0))).alias("processing_time"),
        F.coalesce(worked, F.lit(False)).alias("fallback_used"))


# --- deterministic stand-in converters (tests, bench and the query catalogue) -------------

def echo_converter() -> Converter:
    """Stand-in for the remote service: returns the document text as its Markdown.

    A whole document (``chunk_number`` 0) times out with a 504 if its id is divisible by 13
    and is rejected if it is divisible by 17; a chunk times out if id + chunk_number is
    divisible by 7 and fails without a message if it is divisible by 11. Prompt variants
    (``approach_no``) are rejected if id + approach_no is divisible by 9. The time is one
    millisecond per input character, half a second for a failure.
    """
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        doc, chunk = batch["doc_id"], batch["chunk_number"]
        whole = chunk == 0
        timeout = (whole & (doc % 13 == 0)) | (~whole & ((doc + chunk) % 7 == 0))
        silent = ~whole & ((doc + chunk) % 11 == 0) & ~timeout
        rejected = whole & (doc % 17 == 0) & ~timeout
        if "approach_no" in batch:
            rejected = (rejected | (whole & ((doc + batch["approach_no"]) % 9 == 0))) & ~timeout
        failed = timeout | rejected | silent
        out = pd.DataFrame({
            "status": failed.map({True: "error", False: "success"}),
            "markdown": batch["text"].where(~failed, None),
            "error": pd.Series([None] * len(batch), dtype=object),
            "error_type": pd.Series([None] * len(batch), dtype=object),
            "processing_time": batch["text"].str.len().fillna(0).astype(float) / 1000.0,
        })
        out.loc[timeout, "error"] = "HTTP 504 Gateway Timeout"
        out.loc[timeout, "error_type"] = (doc[timeout] % 2 == 0).map({True: "APITimeoutError", False: "SDKError"})
        out.loc[rejected, "error"] = "bad request"
        out.loc[rejected, "error_type"] = "SDKError"
        out.loc[failed, "processing_time"] = 0.5
        return out
    return run


def ocr_echo_converter() -> Converter:
    """Stand-in for the plain OCR fallback: ids that leave 3 when divided by 4 fail, the others
    take half the time per character."""
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        failed = batch["doc_id"] % 4 == 3
        return pd.DataFrame({
            "status": failed.map({True: "error", False: "success"}), "markdown": batch["text"].where(~failed, None),
            "error": failed.map({True: "no text layer", False: None}), "error_type": failed.map({True: "OCRError", False: None}),
            "processing_time": batch["text"].str.len().fillna(0).astype(float) / 2000.0,
        })
    return run
