"""Intermediate tables in the folder that all executors share, and the spreading of small inputs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode and where none is configured."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='helixframe-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Of tables with long sorted lists of numbers: their differences are packed.
PACKED = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary": "false"}


def stored(df: DataFrame, **options: str) -> DataFrame:
    """df as a table in the folder that all executors share, read again."""
    path = f"{shared_folder(df.sparkSession)}/graphs/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that `shared` broadcasts at most: some 100 bytes each on the driver.
MOST_SHARED = 200_000


def dealt(df: DataFrame) -> DataFrame:
    """df to be dealt by key in a join and never broadcast, for tables that grow with the input.

    Of a stored table the planner knows the compressed bytes alone; in a broadcast, which the driver holds, it may take
    sixty times as many."""
    return df.hint("merge")


def shared(df: DataFrame) -> DataFrame:
    """A stored table to be broadcast in a join if it has few rows, and dealt by key else."""
    return F.broadcast(df) if df.count() <= MOST_SHARED else dealt(df)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it is read in fewer parts than that (a small file, one row group); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = df._jdf.queryExecution().toRdd().getNumPartitions() < cores
    return df.repartition(cores) if few else df
