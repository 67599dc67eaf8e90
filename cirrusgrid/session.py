"""What a session needs before Python runs on its workers, and the folder its executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it, and bounds the methods of generated code.

    The JVM doesn't compile methods of more than 8000 bytes; steps that would need one are run one after the other instead.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark


def keep(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the folder in spark.checkpoint.dir and reads it back, so that steps that follow don't make it anew.

    On one machine alone a folder of our own is set where that is unset, as in tests; on a cluster that is refused.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
