"""Line dedup by a log-template tree, as joins and counts.

A line is parsed to a leaf of a tree of fixed depth: its number of tokens, then its leading
tokens. Tokens that hold a digit are variable fields from the start. Below a leaf the rest
of the line is dealt into slots by position; a slot value found in enough documents
is constant, any other is generalised to a wildcard, and a line with enough constant slots
is an instance of the template that its constants make (other lines are their own
template). Slots that are empty because a line is short do not count either way; a line
without any other is told by its leading tokens. Templates of enough documents recur: their lines are dropped from every document
but one. Everything is counted by partial sums, so no leaf is ever gathered in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docpipe.llm.common import GAP, saved

FIELD = "<*>"


def tokens(line: Column) -> Column:
    """Tokens of a line, those with a digit replaced by a wildcard."""
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*", FIELD)).otherwise(line)
    return F.array_remove(F.split(masked, GAP), "")


def content_key(text: Column) -> list[Column]:
    """128-bit hash of a text (null counts as empty)."""
    filled = F.coalesce(text, F.lit(""))
    return [F.xxhash64(filled).alias("k1"), F.xxhash64(filled, F.lit(1)).alias("k2")]


def parsed_lines(docs: DataFrame, id_col: str, text_col: str, depth: int, slots: int, min_tokens: int) -> DataFrame:
    """``k1, k2, doc_id, line, leaf, slots, n_filled`` of every line of at least ``min_tokens`` tokens.

    ``n_filled`` counts the slots that hold a token.
    """
    # Lines are cut into tokens before they are exploded: as a column of its own the cut would be
    # copied into the filter and so made twice.
    lines = docs.where(F.col(text_col).isNotNull()).select(
        *content_key(F.col(text_col)), F.col(id_col).cast("long").alias("doc_id"),
        F.posexplode(F.transform(F.split(text_col, "\n"), tokens)).alias("line", "words")).where(F.size("words") >= min_tokens)
    n = F.size("words")
    lead = F.least(F.lit(depth), n)
    leaf = F.xxhash64(n, F.slice("words", 1, lead))
    rest = n - lead
    cut = lambda j: lead + 1 + F.floor(rest * j / slots).cast("int")
    values = F.array(*[F.xxhash64(F.slice("words", cut(j), cut(j + 1) - cut(j))) for j in range(slots)])
    return lines.select("k1", "k2", "doc_id", "line", leaf.alias("leaf"), values.alias("slots"),
                        F.least(rest, F.lit(slots)).alias("n_filled"))


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 3, slots: int = 8,
                    least_alike: float = 0.75, min_docs: int = 10, min_tokens: int = 1) -> DataFrame:
    """``k1, k2, line``: lines (0-based, of the text with that hash) whose template recurs in other texts.

    Lines of up to ``depth`` tokens are their own template (digits masked, as in any line).
    Documents are distinct texts: copies of one text do not make its lines recur. Of a
    template's documents the one of smallest id (no id comes last), then of smallest hash,
    keeps its lines.
    """
    lines = parsed_lines(docs, id_col, text_col, depth, slots, min_tokens)
    # A leaf in too few documents holds no recurring template; its lines go no further.
    leaves = lines.select("k1", "k2", "leaf").distinct().groupBy("leaf").agg(F.count("*").alias("docs")).where(
        F.col("docs") >= min_docs).select("leaf")
    # The small sides of the joins below are written first: joined as plain scans, they leave
    # Spark free to broadcast them or to split the partitions of a hot leaf or template.
    lines = saved(lines.join(saved(leaves), "leaf").groupBy("k1", "k2", "line", "leaf", "slots", "n_filled").agg(F.min("doc_id").alias("doc_id")))

    values = lines.select("k1", "k2", "leaf", F.posexplode("slots").alias("slot", "value")).distinct()
    constant = values.groupBy("leaf", "slot", "value").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs)
    exploded = lines.select("*", F.posexplode("slots").alias("slot", "value"))
    kept = F.when(F.col("docs").isNotNull(), F.col("value"))
    # An empty slot is empty in the whole leaf, so it is constant; it says nothing about likeness.
    own_constant = F.count_if(F.col("docs").isNotNull() & (F.col("value") != F.xxhash64(F.array().cast("array<string>"))))
    found = exploded.join(saved(constant), ["leaf", "slot", "value"], "left").groupBy("k1", "k2", "line", "leaf").agg(
        F.sort_array(F.collect_list(F.struct("slot", kept.alias("value")))).alias("constants"),
        own_constant.alias("n_constant"), F.first("slots").alias("slots"), F.first("n_filled").alias("n_filled"),
        F.min("doc_id").alias("doc_id"))
    alike = F.col("n_constant") >= least_alike * F.col("n_filled")
    template = F.xxhash64("leaf", F.when(alike, F.col("constants")), F.when(~alike, F.col("slots")))
    found = saved(found.select("k1", "k2", "line", template.alias("template"), "doc_id"))

    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")
    by_doc = found.groupBy("template", "k1", "k2").agg(F.min("doc_id").alias("doc_id"))
    recurring = by_doc.groupBy("template").agg(F.count("*").alias("docs"), F.min(order).alias("keeper")).where(
        F.col("docs") >= min_docs).select("template", F.col("keeper.k1").alias("keep1"), F.col("keeper.k2").alias("keep2"))
    return found.join(saved(recurring), "template").where("NOT (k1 = keep1 AND k2 = keep2)").select("k1", "k2", "line")


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None,
                         counts: bool = True, **options) -> DataFrame:
    """``docs`` with recurring lines taken out of the text, plus (with ``counts``) ``n_lines`` and ``n_dropped``.

    All other columns stay as they are (with ``counts``, ``n_lines`` and ``n_dropped`` of the
    input are replaced); where lines went, ``length_col`` is set to the characters of the new
    text. A null text stays null, with 0 lines; an empty text is one empty line; equal
    rows are treated equally; a text all of whose lines recur becomes empty; an empty table
    gives no rows. Texts meet their lines by content hash, so ids may be null or repeat.
    """
    flagged = recurring_lines(docs, id_col, text_col, **options).groupBy("k1", "k2").agg(
        F.collect_set("line").alias("flagged")).toDF("f1", "f2", "flagged")
    rows = docs.select(F.struct("*").alias("doc"), F.col(text_col).alias("line_text"), *content_key(F.col(text_col)))
    rows = rows.join(saved(flagged), (F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2")), "left")
    lines = F.split("line_text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "flagged")
    touched = F.col("flagged").isNotNull() & F.col("line_text").isNotNull()
    text = F.when(touched, F.array_join(F.transform(left, lambda i: F.element_at(lines, i + 1)), "\n")).otherwise(F.col("line_text"))
    rows = rows.select("doc", text.alias("text"), touched.alias("touched"),
                       F.when(F.col("line_text").isNotNull(), F.size(lines)).otherwise(0).alias("n_lines"),
                       F.when(touched, F.size("flagged")).otherwise(0).alias("n_dropped"))

    def column(name: str) -> Column:
        old = F.col("doc").getField(name)
        if name == text_col:
            return F.col("text").alias(name)
        if name == length_col:
            return F.when(F.col("touched"), F.length("text").cast(docs.schema[name].dataType)).otherwise(old).alias(name)
        return old.alias(name)

    if not counts:
        return rows.select(*map(column, docs.columns))
    return rows.select(*[column(c) for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")
