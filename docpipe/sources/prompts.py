"""Prompt variants for the conversion step.

The catalogue is a fixed dimension of eight named variants (plus an optional custom prompt
read from a file). Fanning documents out over it needs no join: each document row expands
into one row per variant through ``explode`` of a literal array, a narrow operation.
The prompt texts are this project's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docpipe.constants import APPROACH_NAMES

_BASE = ("Convert this document to Markdown. Keep headings as #, ## and ###, keep lists and "
         "tables, and mark emphasis exactly: bold as **text**, italic as *text*, bold italic "
         "as ***text***. Return only the Markdown.")

PROMPTS: dict[str, str] = {
    "default": _BASE,
    "aggressive": _BASE + " Inspect every word for weight and slant changes; when unsure, keep the emphasis.",
    "minimal": "Return this document as Markdown with its emphasis (**bold**, *italic*) kept.",
    "llamaparse": _BASE + " Follow the layout of a parser: one section per heading, tables as pipe tables.",
    "italic_focused": _BASE + " Italic text is easy to miss: look for slanted words in running text and lists.",
    "style_hunter": _BASE + " Treat each line as a search for styled words before writing it out.",
    "ultra_precise": _BASE + " Copy the text character for character; never summarise or reorder.",
    "laser_focused": _BASE + " Focus on inline emphasis inside sentences, not only on whole lines.",
}
assert list(PROMPTS) == APPROACH_NAMES


def prompt_catalog(spark: SparkSession, custom_prompt: str | None = None) -> DataFrame:
    """approach, prompt, prompt_length (a bounded dimension table, 8 or 9 rows)."""
    rows = list(PROMPTS.items()) + ([("custom", custom_prompt)] if custom_prompt else [])
    return spark.createDataFrame(rows, "approach string, prompt string").withColumn(
        "prompt_length", F.length("prompt"))


def read_prompt_file(spark: SparkSession, path: str) -> str:
    """A custom prompt file (one small text file) read whole; a path that names another number
    of files is an error."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} names {'no file' if not rows else 'several files'}, one is needed")
    return rows[0][0]


def approaches_literal(custom_prompt: str | None = None) -> Column:
    """ARRAY<STRUCT<approach_no, approach, prompt>> literal of the catalogue."""
    items = list(PROMPTS.items()) + ([("custom", custom_prompt)] if custom_prompt else [])
    return F.array(*[F.struct(F.lit(i + 1).alias("approach_no"), F.lit(name).alias("approach"),
                              F.lit(text).alias("prompt")) for i, (name, text) in enumerate(items)])


def prompt_type(prompt_given: Column) -> Column:
    """``custom`` when a prompt was passed in, else ``default``."""
    return F.when(prompt_given, F.lit("custom")).otherwise(F.lit("default"))


def fan_out(docs: DataFrame, approaches: list[str] | None = None, custom_prompt: str | None = None) -> DataFrame:
    """docs x prompt variants: adds approach_no, approach, prompt, prompt_length, prompt_type.

    ``approaches=None`` is the "all variants" run, where every variant's text — the
    default one included — is passed as a prompt, so every row is ``custom``. With a
    chosen list each run is a single-approach run, where ``default`` passes no prompt.
    """
    arr = approaches_literal(custom_prompt)
    if approaches is not None:
        wanted = F.array(*[F.lit(a) for a in approaches])
        arr = F.filter(arr, lambda a: F.array_contains(wanted, a["approach"]))
    passed = F.lit(True) if approaches is None else (F.col("_a.approach") != "default")
    out = docs.withColumn("_a", F.explode(arr))
    return out.select(*docs.columns, "_a.approach_no", "_a.approach", "_a.prompt",
                      F.length("_a.prompt").alias("prompt_length"),
                      prompt_type(passed).alias("prompt_type"))
