"""Session settings and the shared scratch folder.

Cluster values (executor memory, shuffle partitions, checkpoint folder) belong to the job that
submits the work; ``local_session`` only fills in what tests and the bench need.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "12g",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

#: The temporary folders of local applications: a running session takes no value for spark.checkpoint.dir.
_LOCAL_DIRS: dict[str, str] = {}


def local_session(app: str = "partsight", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in {**_LOCAL_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir`` of the session.

    Only when none is named (local tests) is a temporary folder made, one for each application.
    """
    application = spark.sparkContext.applicationId
    named = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL_DIRS.get(application)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="partsight-", dir=os.environ.get("TMPDIR", "/tmp"))
        _LOCAL_DIRS[application] = named
    return named


def run_dir(spark: SparkSession, what: str) -> str:
    """A fresh sub-folder of the shared folder for one run."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt evenly over all cores, for work that costs far more than a shuffle of its input.

    A table of millions of short rows is a few megabytes on disk and one row group: without this, one or two tasks do
    all the work. A batch of a stream stays as it is.
    """
    if rows.isStreaming:
        return rows
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))
