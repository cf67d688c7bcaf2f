"""One file per run: names, no half files, nothing overwritten."""

import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from docpipe.operators.results import job_ids
from docpipe.sources import named_files as N


def write(spark, rows, path, parts=3):
    N.write_named(spark.createDataFrame(rows, N.SCHEMA).repartition(parts), str(path))


def read(path):
    return {f: open(os.path.join(path, f), encoding="utf-8").read() for f in os.listdir(path) if f != N.STAGING}


def test_names_and_contents(spark, tmp_path):
    write(spark, [(f"d{k}_job.md", f"d{k}_job_u.md", f"# é {k}\n") for k in range(30)] + [("empty.md", "e2.md", None)], tmp_path)
    assert read(tmp_path) == {f"d{k}_job.md": f"# é {k}\n" for k in range(30)} | {"empty.md": ""}
    assert os.listdir(tmp_path / N.STAGING) == []


def test_nothing_is_overwritten(spark, tmp_path):
    write(spark, [("a.md", "a_1.md", "one"), ("a.md", "a_2.md", "two"), ("b.md", "b_1.md", "b")], tmp_path)
    assert read(tmp_path) == {"a_1.md": "one", "a_2.md": "two", "b.md": "b"}
    write(spark, [("b.md", "b_1.md", "again")], tmp_path)
    write(spark, [("b.md", "b_1.md", "once more"), ("c", "c", "x")], tmp_path)
    write(spark, [("c", "c", "y")], tmp_path)
    assert read(tmp_path) == {"a_1.md": "one", "a_2.md": "two", "b.md": "b", "b_1.md": "again", "b_1-2.md": "once more", "c": "x", "c-2": "y"}


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    write(spark, [("kept.md", "kept_1.md", "k")], tmp_path)
    rows = spark.createDataFrame([(f"n{k}.md", f"n{k}_u.md", "text") for k in range(20)], N.SCHEMA).repartition(4)
    broken = rows.withColumn("content", F.when(F.col("name") == "n7.md", F.raise_error(F.lit("lost"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        N.write_named(broken, str(tmp_path))
    with pytest.raises(Exception, match="not a file name"):
        write(spark, [("../x.md", "y.md", "no")], tmp_path)
    assert read(tmp_path) == {"kept.md": "k"} and os.listdir(tmp_path / N.STAGING) == []
    assert not os.path.exists(tmp_path.parent / "x.md")


def test_files_of_runs_have_the_names_of_job_ids(spark, tmp_path):
    from docpipe.plans.catalog import REGISTRY
    from docpipe.sources import fixtures as FX
    meta = REGISTRY["run_metadata"].run(spark, SF_SMALL).limit(40).cache()
    texts = meta.select("doc_id", F.concat(F.lit("# "), F.col("doc_id").cast("string")).alias("markdown"))
    N.write_run_files(meta, str(tmp_path), texts)
    found, rows = read(tmp_path), meta.collect()
    assert len([f for f in found if f.endswith("_metadata.json")]) == len(rows)
    assert len([f for f in found if f.endswith(".md")]) == sum(r.status == "success" for r in rows)
    names = {}
    for r in rows:
        names.setdefault(r.source_pdf.rsplit(".", 1)[0] + "_" + r.job_id, []).append(r)
    for base, runs in names.items():
        for r in runs:
            own = base if len(runs) == 1 else base.replace(r.job_id, r.unique_job_id)
            record = json.loads(found[own + "_metadata.json"])
            assert record["job_id"] == r.job_id and record["status"] == r.status
            assert record["output_markdown"] == (own + ".md" if r.status == "success" else None)
            if r.status == "success":
                assert found[own + ".md"] == f"# {r.doc_id}"
                assert len(runs) > 1 or record["output_markdown"] == r.output_markdown
    ids = job_ids(spark.createDataFrame([(1, "/c/Rule Book.v2.pdf")], "doc_id long, path string"), F.lit("2024-01-30 12:00:05").cast("timestamp_ntz"))
    one = N.run_files(ids.select(F.col("source_name").alias("source_pdf"), "job_id", "unique_job_id", F.lit(None).cast("string").alias("approach"),
                                 "output_markdown", "output_metadata")).first()
    assert (one.markdown_file, one.metadata_file) == (one.output_markdown, one.output_metadata)
    custom = N.run_files(ids.select(F.col("source_name").alias("source_pdf"), "job_id", "unique_job_id", F.lit("custom").alias("approach"))).first()
    assert custom.markdown_file == "Rule Book.v2_custom_job_20240130_120005_Rule Book.v2.md"


def test_tasks_move_the_files_and_may_be_repeated(spark, tmp_path):
    """Rows of one name meet in one task, none is overwritten; what an earlier attempt has moved stays where it is."""
    import pyarrow as pa
    rows = [("a.md", "a_1.md", "first"), ("b.md", "b_1.md", "b"), ("b.md", "b_1.md", "b again"), ("b.md", "b_1.md", "b once more"),
            ("old.md", "old_1.md", "new"), ("c.md", "a.md", "c")]
    (tmp_path / "old.md").write_text("old")
    writer = N.NamedFilesWriter(str(tmp_path), "run")
    staged = writer.write(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["name", "second_name", "content"])]))
    writer.commit([staged])
    assert sorted(f for f in os.listdir(tmp_path) if f != N.STAGING) == ["old.md"]          # the driver's commit moves none
    os.rename(f"{staged.folder}/0", tmp_path / "a.md")
    N.place_all(spark.createDataFrame([(staged.folder,)], "folder string"), str(tmp_path))
    found = read(tmp_path)
    assert {found.pop(k) for k in ("b.md", "b_1.md", "b_1-2.md")} == {"b", "b again", "b once more"}
    assert found == {"a.md": "first", "old.md": "old", "old_1.md": "new", "c.md": "c"}


def test_a_listing_takes_many_files_in_a_task(spark, tmp_path):
    from docpipe.sources.files import list_files
    write(spark, [(f"d{k}.txt", f"e{k}.txt", "x" * (k + 1)) for k in range(400)], tmp_path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")                    # a file counts as 4 MB at least
    try:
        files = list_files(spark, f"file://{tmp_path}")
        assert files.rdd.getNumPartitions() <= max(4 * spark.sparkContext.defaultParallelism, 4)
        assert sorted(r.file_size_bytes for r in files.collect()) == list(range(1, 401))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_folder_is_listed_by_tasks_as_spark_lists_it(spark, tmp_path):
    """The driver's frame holds no file, its size is not taken for small, and rows are those of binaryFile."""
    from docpipe.sources.files import list_files
    for folder in ("", "b c/deep", "_hidden", ".hidden", "_metadata_of", "k=1/_x=2", "none"):
        os.makedirs(tmp_path / folder, exist_ok=True)
        for k, name in enumerate(("1.txt", "é 2.txt", "empty.md", "_no", ".no", "_yes=1", "part._COPYING_", "_metadata")):
            if folder != "none":
                (tmp_path / folder / name).write_bytes(b"x" * (k * (name != "empty.md") + (name == "1.txt")))
    os.utime(tmp_path / "1.txt", ns=(0, 1_700_000_000_123_456_789))
    os.symlink(tmp_path / "1.txt", tmp_path / "link.txt")
    os.symlink(tmp_path / "gone", tmp_path / "broken.txt")
    want = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).select("path", "length", "modificationTime")
    want = sorted(map(tuple, want.collect()))
    for path in (str(tmp_path), f"{tmp_path}/", f"file://{tmp_path}", f"file:{tmp_path}"):
        files = list_files(spark, path)
        assert files.inputFiles() == [] and files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() >= 1 << 40
        assert sorted(map(tuple, files.select("path", "file_size_bytes", "modified").collect())) == want
        assert files.where(F.col("doc_id") != F.xxhash64("path")).isEmpty()
    assert len(want) == 13 and [r["path"] for r in list_files(spark, f"{tmp_path}/b*/*/1.txt").collect()] == [f"file:{tmp_path}/b c/deep/1.txt"]
    assert [r["file_size_bytes"] for r in list_files(spark, f"{tmp_path}/1.txt").collect()] == [1]
    assert list_files(spark, f"{tmp_path}/b c/deep", recursive=False).count() == 3
    assert list_files(spark, f"{tmp_path}/none").isEmpty()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        list_files(spark, f"{tmp_path}/missing")
