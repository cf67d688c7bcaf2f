"""Session helpers.

Library code never creates a session on its own; these helpers are for tests, the bench
and command-line use. Cluster deployments pass their own session in.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app_name: str = "docpipe",
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Local/test session with AQE on, UTC clock and Arrow enabled."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Broadcast only on measured sizes: no static broadcast from file-size estimates
        # (compressed parquet understates memory); AQE may still switch a join to a
        # broadcast once a shuffle stage has run and its real size is below the threshold.
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        # checkpoints written by reliable() are removed once nothing references them
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # transformWithState (hung-job alerts, completed parents) needs named state columns
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.driver.memory": "16g",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster (``spark.checkpoint.dir``).

    Only a local-mode session (tests, bench) without the setting gets a scratch folder; on
    a cluster the setting must name a folder every executor can reach.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():                       # set once: each setting adds a folder of its own below it
        return sc.getCheckpointDir()
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...) for this cluster")
        current = tempfile.mkdtemp(prefix="docpipe-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", current)
    sc.setCheckpointDir(current)
    return current


def reliable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    Used where a costly or non-repeatable step (a remote conversion call) feeds several
    branches: the branches read the checkpoint instead of re-running the step, and a lost
    executor does not send the step to the service again.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
