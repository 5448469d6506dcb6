"""Recruitment over arriving files: the batch operator on each micro-batch, counts kept as a running table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from helixframe.operators import recruit


def recruit_files(spark: SparkSession, folder: str, schema: str, refs: DataFrame, k: int, out: str, checkpoint: str, step: int = 1, files_a_batch: int = 16) -> StreamingQuery:
    """Parquet files of fragments (frag, seq) that arrive in folder; hits (frag, locus, batch) go to out, a batch's rows
    replacing those of an earlier attempt at it."""
    index = recruit.reference_index(refs, "locus", "seq", k)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)

    def each(batch: DataFrame, number: int) -> None:
        recruit.recruit(batch, "frag", ["seq"], index, k, step).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counts(spark: SparkSession, out: str) -> DataFrame:
    """locus, reads over all batches; a fragment that arrived twice counts once."""
    return spark.read.parquet(out).select("frag", "locus").distinct().groupBy("locus").agg(F.count(F.lit(1)).alias("reads"))


def distinct_pairs(stream: DataFrame, id_: str, time: str, delay: str = "1 hour") -> DataFrame:
    """A stream without fragments that repeat within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([id_])
