"""Session settings the rest of the package relies on."""

from __future__ import annotations

import re
import uuid
from tempfile import gettempdir

from pyspark.sql import DataFrame, SparkSession

#: Folder chosen for a single-machine session that names none, by application.
_LOCAL: dict[str, str] = {}


def build_session(app_name: str = "wattlake", master: str | None = None, **conf: str) -> SparkSession:
    """A UTC-pinned session with adaptive execution.

    Only what the semantics need is set here: cluster sizing (executors,
    shuffle partitions, checkpoint folder) belongs to ``spark-submit``.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def require_utc(spark: SparkSession) -> None:
    """Hour truncation happens in the session zone, so any other zone is an error."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z"):
        raise ValueError(f"session time zone must be UTC, found {zone}")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share.

    A session that names none gets one only where there is one machine, that
    is with a ``local[...]`` master, as in tests. On a cluster it is an error:
    an executor's own disk would hold tables that nobody else can read.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder shared by the cluster (master {master})")
        folder = _LOCAL.setdefault(spark.sparkContext.applicationId, f"{gettempdir()}/spark-{uuid.uuid4().hex}")
    return folder.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder inside the shared folder for tables written between steps."""
    return f"{shared_folder(spark)}/wattlake-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df`` in the folder named by ``spark.checkpoint.dir``.

    It survives lost executors, unlike a local checkpoint.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def stored_table(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back with its schema.

    It cuts the plan like a checkpoint, and gives Spark the table's size in
    bytes, by which it chooses to broadcast it or not.
    """
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
