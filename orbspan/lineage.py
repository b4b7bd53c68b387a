"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Setting that names the shared folder.
SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the one given to the context.

    Where neither is set, a session in this one process (local mode, as in tests)
    gets a folder of its own; on a cluster that is an error, as a folder of one
    machine would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get(SETTING, None) or spark.conf.get(SETTING, None)
    given = sc._jsc.sc().getCheckpointDir()
    if not folder and given.isDefined():
        folder = given.get()
    if not folder:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError(f"{SETTING} must name a folder that all executors share.")
        folder = tempfile.mkdtemp(prefix="orbspan-")
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read back from a table in the shared folder.

    The rows are computed once (an eager checkpoint() computes them for a count and
    again for its files) and are columns with a known size from then on.  The
    tables go when the application ends.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/orbspan-{sc.applicationId}/{uuid.uuid4().hex}")
    files = path.getFileSystem(sc._jsc.hadoopConfiguration())
    df.write.parquet(path.toString())
    files.deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(path.toString())
