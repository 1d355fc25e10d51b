"""Session helpers: recommended settings and materialisation that survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings every job of this library assumes; callers may override any of them.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder used by :func:`materialize`.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without that setting gets a
    temporary folder; on a cluster a missing setting is an error, since a machine-local folder would be
    lost with its executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spanloom-")
    sc.setCheckpointDir(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and continue from the files.

    Called where one result feeds several branches, so that upstream work runs once and a lost executor re-reads
    files instead of replaying the job. Unlike a checkpoint of rows, the files are columnar: each branch reads only
    the columns it needs, and their size is known to the planner. The files stay until the folder is cleared, as
    those of a checkpoint do.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
