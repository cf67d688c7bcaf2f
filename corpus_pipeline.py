"""The corpus pipeline: STAGES over ``documents``, each stage one operator of docpipe.llm.

Every stage takes rows with null ids, texts, sources or other columns, empty texts, repeated
rows, empty tables and any further columns, whatever their names; what each of them gives
is said at its operator. A null text has no words, no lines to lose and leaks nothing; rows
that share a near-duplicate group, null and empty texts included, leave one row. The mix
adds one column, ``mix``, which replaces an input column of that name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docpipe.llm import decontam, linetemplates, mixing, quality, simhash
from docpipe.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~quality.held_out()))
    return quality.accepted(docs, model)


def without_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines whose template recurs; where lines went, n_chars is that of the new text."""
    return linetemplates.drop_recurring_lines(docs, length_col="n_chars", counts=False)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.one_per_group(docs, shingle=4, radius=4)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of the documents that the mix takes, with the words taken of each.

    Rows that agree in doc_id and text are one document here; the copies carry the columns
    of ``docs`` and those of the mix under names of their own.
    """
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality", good_documents),
    ("lines", without_recurring_lines),
    ("near_copies", one_of_near_copies),
    ("decontaminate", without_benchmark),
    ("mix", mix_sources),
]

#: Not expressible in SQL (trained classifier, iterated components): tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over all documents; between stages the rows go through Parquet in the shared folder.

    A stage's rows are deleted when the next stage's are written; the last ones stay, as the
    mix reads them.
    """
    import uuid
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/corpus-pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            before = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
            before.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(before, True)
    return STAGES[-1][1](spark, docs, sf_dir)
