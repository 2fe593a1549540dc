"""Where intermediate results are kept, and how lineage is cut.

Intermediate results are Parquet tables in the folder that all executors share (``spark.checkpoint.dir``), so that a lost executor costs no more than its own tasks.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate results: ``spark.checkpoint.dir`` of the session; where that is unset, as in tests, the context's or a new temporary one."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame, name: str = "part") -> DataFrame:
    """Write df once as Parquet into the shared folder and read it back: the plan after it starts at the files.

    The files stay until the application's folder is removed; a query that returned lazily may still read them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
