"""The session every entry point and test uses."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[8]", *, app: str = "snapstats", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and ANSI on; ``conf`` keys use ``__`` for a dot."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only on one machine a new temporary folder is set where none is named; on a cluster that would not be shared.
    """
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not given:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        given = tempfile.mkdtemp(prefix="spark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(given)
    return given


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as a Parquet table and read again: its size is known to the planner."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a plain table that one task sorts or counts at once.
TASK_ROWS = 1_000_000


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by its keys in as many partitions as its rows ask for: the shuffle's own number, or more where a task would have over ``TASK_ROWS``.

    The rows are counted from the footers of the files, so ``df`` should be a table as it is read.
    """
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(own, -(-df.count() // TASK_ROWS)), *keys)
