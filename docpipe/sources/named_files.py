"""A sink that writes one file per row, under the name the row gives.

Tasks write into staging folders of their own; only when the whole job has written are files
moved to their names, so a failed task or job leaves no half file and no file at all. A name that is
taken, by another row of the job or by an earlier run, is never overwritten: the row's second
name is used then, with a number if that is taken too. ``write_named`` moves files in tasks, dealt
by name; the driver moves those only that need a number.

Paths are URIs that ``pyarrow.fs`` knows (``file://``, ``hdfs://``, ``s3://`` ...) or plain
paths of a folder that the driver and all executors share.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from docpipe.session import reliable

FORMAT = "named_files"
SCHEMA = "name string, second_name string, content string"
STAGING = "_staging"
#: In a task's staging folder, the names of its files by line; in a job's, the folders of the tasks that ended well.
NAMES, COMMITTED = "names", "committed"


def file_system(path: str):
    """The file system of a path and the path's name there."""
    from pyarrow import fs
    if path.startswith("file:"):                    # file:/x and file:///x alike
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _free(fs, path: str) -> bool:
    from pyarrow import fs as pafs
    return fs.get_file_info(path).type == pafs.FileType.NotFound


def _names(fs, folder: str) -> Iterator[tuple[str, str, str]]:
    """Staged file, name and second name of each row of a task."""
    with fs.open_input_stream(f"{folder}/{NAMES}") as given:
        for n, line in enumerate(given.read().decode().splitlines()):
            yield f"{folder}/{n}", *json.loads(line)


def _place(fs, root: str, staged: str, name: str, second: str) -> None:
    """Move a file to the first of its names that is free."""
    stem, dot, kind = second.rpartition(".")
    k, target = 2, name if _free(fs, f"{root}/{name}") else second
    while not _free(fs, f"{root}/{target}"):
        target, k = f"{stem}-{k}{dot}{kind}" if dot else f"{second}-{k}", k + 1
    fs.move(staged, f"{root}/{target}")


@dataclass
class Staged(WriterCommitMessage):
    """A task's staging folder; the names stay in it."""
    folder: str


class NamedFilesWriter(DataSourceArrowWriter):
    """With ``run`` given, the commit leaves the files in that staging folder for tasks to move."""

    def __init__(self, path: str, run: str | None = None):
        self.path, self.run, self.held = path.rstrip("/"), run or uuid.uuid4().hex, run is not None

    def write(self, batches: Iterator) -> Staged:
        fs, root = file_system(self.path)
        folder = f"{root}/{STAGING}/{self.run}/{uuid.uuid4().hex}"
        fs.create_dir(folder, recursive=True)
        n = 0
        with fs.open_output_stream(f"{folder}/{NAMES}") as names:
            for batch in batches:
                for name, second, content in zip(*(batch.column(c).to_pylist() for c in ("name", "second_name", "content"))):
                    if not name or "/" in name or "/" in (second or ""):
                        raise ValueError(f"not a file name: {name!r}, {second!r}")
                    with fs.open_output_stream(f"{folder}/{n}") as out:
                        out.write((content or "").encode())
                    names.write(json.dumps([name, second or name]).encode() + b"\n")
                    n += 1
        return Staged(folder)

    def commit(self, messages: list[Staged | None]) -> None:
        fs, root = file_system(self.path)
        staging, folders = f"{root}/{STAGING}/{self.run}", [m.folder for m in messages if m is not None]
        if self.held:
            fs.create_dir(staging, recursive=True)
            with fs.open_output_stream(f"{staging}/{COMMITTED}") as out:
                out.write(json.dumps(folders).encode())
            return
        for folder in folders:
            for row in _names(fs, folder):
                _place(fs, root, *row)
        if folders:
            fs.delete_dir(staging)

    def abort(self, messages: list[Staged | None]) -> None:
        fs, root = file_system(self.path)
        if not _free(fs, f"{root}/{STAGING}/{self.run}"):
            fs.delete_dir(f"{root}/{STAGING}/{self.run}")


class NamedFiles(DataSource):
    """``df.write.format("named_files").save(path)`` for columns name, second_name, content."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        if overwrite:
            raise ValueError("files are only ever added: use mode('append')")
        if [f.name for f in schema.fields] != ["name", "second_name", "content"]:
            raise ValueError(f"the columns must be {SCHEMA}")
        return NamedFilesWriter(self.options["path"], self.options.get("run"))


def write_named(files: DataFrame, path: str) -> None:
    """Write ``name, second_name, content`` as files.

    Rows that share a name all take their second name, whichever task they are in.
    """
    files.sparkSession.dataSource.register(NamedFiles)
    shared = files.groupBy("name").agg(F.count("*").alias("_n")).where("_n > 1").select("name", F.lit(True).alias("_shared"))
    out = files.join(shared, "name", "left").select(
        F.when(F.col("_shared"), F.col("second_name")).otherwise(F.col("name")).alias("name"), "second_name", "content")
    run = uuid.uuid4().hex
    out.write.format(FORMAT).option("run", run).mode("append").save(path)
    fs, root = file_system(path.rstrip("/"))
    staging = f"{root}/{STAGING}/{run}"
    try:
        with fs.open_input_stream(f"{staging}/{COMMITTED}") as given:
            folders = json.loads(given.read())
        if folders:
            place_all(files.sparkSession.createDataFrame([(f,) for f in folders], "folder string"), path)
    finally:
        fs.delete_dir(staging)


CLAIMS = "staged string, name string, second string"


def place_all(folders: DataFrame, path: str) -> None:
    """Move the files of staging folders (column folder) to their names.

    Rows that want one name meet in one task, so no move overwrites another's; a file that an
    earlier attempt of a task has moved is gone from its staging folder.
    """
    path = path.rstrip("/")

    def claims(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(path)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows = list(_names(fs, folder))
                for at in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows[at:at + 10_000])],
                                                     names=["staged", "name", "second"])

    def moved_to(which: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, root = file_system(path)
            for batch in batches:
                taken = []
                for i, row in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                    if _free(fs, row[0]):
                        continue
                    if not _free(fs, f"{root}/{row[which]}"):
                        taken.append(i)
                        continue
                    try:
                        fs.move(row[0], f"{root}/{row[which]}")
                    except FileNotFoundError:           # another attempt of this task was faster
                        if not _free(fs, row[0]):
                            raise
                yield batch.take(pa.array(taken, pa.int64()))
        return run

    tasks = int(folders.sparkSession.conf.get("spark.sql.shuffle.partitions"))       # a name is few bytes but much work: not to be coalesced
    rest = folders.repartition(tasks, "folder").mapInArrow(claims, CLAIMS)
    for which, column in ((1, "name"), (2, "second")):
        rest = reliable(rest.repartition(tasks, column).mapInArrow(moved_to(which), CLAIMS))
    fs, root = file_system(path)
    for row in rest.coalesce(1).toLocalIterator():
        _place(fs, root, *row)


def output_base(source_name, approach, job_id):
    """``{stem}_{job}``, with a prompt variant ``{stem}_{approach}_{job}`` (Column): the part that a run's files share."""
    from docpipe.operators.jobs import stem
    return F.concat_ws("_", stem(source_name), approach, job_id)


def run_files(runs: DataFrame) -> DataFrame:
    """The file names of each run: ``output_markdown`` and ``output_metadata``, and unique ones (``unique_...``).

    ``runs``: source_pdf, job_id, unique_job_id, approach (null: none).
    """
    plain = output_base(F.col("source_pdf"), F.col("approach"), F.col("job_id"))
    unique = output_base(F.col("source_pdf"), F.col("approach"), F.col("unique_job_id"))
    return runs.select("*", *[F.concat(base, F.lit(end)).alias(name) for base, end, name in (
        (plain, ".md", "markdown_file"), (plain, "_metadata.json", "metadata_file"),
        (unique, ".md", "unique_markdown_file"), (unique, "_metadata.json", "unique_metadata_file"))])


def write_run_files(metadata: DataFrame, path: str, texts: DataFrame | None = None, keys: list[str] | None = None) -> None:
    """One metadata file per run and, with ``texts`` (the keys, markdown), one Markdown file per successful run.

    ``metadata``: ``operators.results.run_metadata``. Files are named as the runs name them; a
    successful run's metadata names its Markdown file as it is written, so where two runs
    of one job share a name both carry their unique one.
    """
    from docpipe.sources.sinks import metadata_records
    keys = keys or ["doc_id"]
    shared = run_files(metadata).groupBy("markdown_file").agg(F.count("*").alias("_n")).where("_n > 1").select(
        "markdown_file", F.lit(True).alias("_shared"))
    named = run_files(metadata).join(shared, "markdown_file", "left").withColumn("_shared", F.coalesce("_shared", F.lit(False)))
    own = F.when(F.col("_shared"), F.col("unique_markdown_file")).otherwise(F.col("markdown_file"))
    named = named.withColumn("output_markdown", F.when(F.col("status") == "success", own))
    names = named.select(*keys, F.when(F.col("_shared"), F.col("unique_metadata_file")).otherwise(F.col("metadata_file")).alias("name"),
                         F.col("unique_metadata_file").alias("second_name"), own.alias("_text_name"), "unique_markdown_file", "status")
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    records = metadata_records(named).withColumn("approach", F.col("metadata.approach")).alias("r")
    bodies = names.alias("n").join(records, same).select(
        "n.name", "n.second_name", F.to_json("r.metadata", {"ignoreNullFields": "false", "pretty": "true"}).alias("content"))
    write_named(bodies, path)
    if texts is not None:
        text = texts.alias("r")
        good = names.where("status = 'success'").alias("n").join(text, same)
        write_named(good.select(F.col("n._text_name").alias("name"), F.col("n.unique_markdown_file").alias("second_name"),
                                F.col("r.markdown").alias("content")), path)
