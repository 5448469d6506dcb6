"""Exact deduplication with a persistent digest index, bucketed and sorted by digest.

`DigestIndex` holds one row for each distinct text: digest, doc_id of the row that stays, number of copies in the
batch that brought it.  A batch is reduced to one row per digest (partial aggregation before the shuffle), dealt as
the index is, compared with it by a sort-merge anti-join in which the index is not shuffled, and what is new is
appended.  Each append adds one file to a bucket, so that tasks sort the index's buckets again, each its own.

An index is reopened by its name, or in another session by its path: its place and its number of buckets come from
the catalog or from a small file beside it, not from the session's settings.

A table without an index of earlier rows goes through a new one in BATCHES batches by falling doc_id, so that the
row that the index has is the row that stays, and later batches are anti-joined with earlier ones.

Defined results: a null text counts as empty; texts of any length are hashed whole; of equal texts the largest doc_id
stays (rows without one only among themselves); rows that repeat a doc_id each come out, kept if their doc_id is the
one that stays, but `deduplicated` leaves one row of them; an empty table gives an empty result; other columns,
whatever their names, are not looked at.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import digest, fresh_path, join_groups, only_kept, table, written

#: Batches in which a table without an earlier index is added.
BATCHES = 2


class DigestIndex:
    """A table (text_sha256, keep_id, group_size), bucketed and sorted by text_sha256."""

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None):
        """Opens the index of this name or path, or makes an empty one; `buckets` is for a new one."""
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        if spark.catalog.tableExists(self.name):
            about = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {self.name}").collect()}
            self.path, self.buckets = about["Location"], int(about["Num Buckets"])
            return
        self.path = path or fresh_path(spark, "digest-index")
        there = self._noted_buckets()
        # As many as the shuffle has partitions, if nothing else is said.
        self.buckets = there or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not there:
            spark.range(1).select(F.lit(str(self.buckets)).alias("value")).coalesce(1).write.text(f"{self.path}.buckets")
        spark.sql(
            f"CREATE TABLE {self.name} (text_sha256 STRING, keep_id BIGINT, group_size BIGINT) USING parquet OPTIONS (path '{self.path}') "
            f"CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {self.buckets} BUCKETS"
        )

    def _noted_buckets(self) -> int | None:
        """The number of buckets of an index that another session wrote to the path."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}.buckets")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return int(self.spark.read.text(f"{self.path}.buckets").first()["value"])

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """Those of groups (one row per digest) whose digest the index lacks."""
        dealt = groups.repartition(self.buckets, "text_sha256")
        return dealt.join(self.read().select("text_sha256").hint("merge"), "text_sha256", "left_anti")

    def append(self, groups: DataFrame) -> None:
        dealt = groups.select("text_sha256", "keep_id", "group_size").repartition(self.buckets, "text_sha256")
        writer = dealt.write.format("parquet").mode("append").bucketBy(self.buckets, "text_sha256").sortBy("text_sha256")
        writer.option("path", self.path).saveAsTable(self.name)

    def add(self, digests: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Indexes what is new in digests (doc_id, text_sha256).

        All its groups, one row for each digest (text_sha256, keep_id, group_size), and those that were new.
        """
        groups = digests.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        groups = written(groups, "batch-groups")
        new = written(self.unseen(groups), "unseen")
        self.append(new)
        return groups, new


def batches(digests: DataFrame, n: int) -> list[DataFrame]:
    """digests (doc_id, text_sha256) in n parts by falling doc_id, rows without one in the last."""
    cuts = digests.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 1000).alias("cuts")).first()["cuts"] if n > 1 else None
    if not cuts:
        return [digests]
    falling = sorted(set(cuts), reverse=True)
    doc_id = F.col("doc_id")
    parts = [digests.where(doc_id > falling[0])]
    parts += [digests.where((doc_id <= high) & (doc_id > low)) for high, low in zip(falling, falling[1:], strict=False)]
    return [*parts, digests.where(doc_id.isNull() | (doc_id <= falling[-1]))]


def classes(documents: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """doc_id, text_sha256, keep_id, group_size, kept for each row; with an index, copies of what it has are not kept.

    group_size counts the rows of documents.
    """
    spark = documents.sparkSession
    digests = written(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), digest(F.col("text")).alias("text_sha256")), "digests")
    parts = [digests] if index else batches(digests, BATCHES)
    used = index or DigestIndex(spark)
    added = [used.add(x) for x in parts]
    groups, new = added[0]
    for more, more_new in added[1:]:
        groups, new = groups.unionByName(more), new.unionByName(more_new)
    sizes = groups.groupBy("text_sha256").agg(F.sum("group_size").alias("group_size"))
    kept = used.read().select("text_sha256", "keep_id")
    fresh = new.select("text_sha256", F.lit(True).alias("is_new"))
    sizes = sizes.join(kept.hint("merge"), "text_sha256").join(fresh.hint("merge"), "text_sha256", "left")
    sizes = written(sizes.withColumn("is_new", F.coalesce("is_new", F.lit(False))), "groups")
    if not index:
        spark.sql(f"DROP TABLE {used.name}")  # the catalog's entry; the files are intermediate tables like others
    found = join_groups(digests, sizes, "text_sha256", "group_size", digests.count())
    return found.withColumn("kept", F.col("is_new") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).drop("is_new")


def deduplicated(documents: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of documents that stay, each with all its columns."""
    return only_kept(documents, classes(documents, index))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY digest) AS keep_id, count(*) OVER (PARTITION BY digest) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY digest) AS kept, digest AS text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents)
"""
