"""What the operators of this subpackage share: tables, written intermediate results, skew-safe joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key counts as hot from this many rows on; more on large inputs, so that hot keys stay few.
HOT_ROWS = 256
#: No more than so many keys can be hot, since each has over 1/MOST_HOT of all rows or HOT_ROWS of them.
MOST_HOT = 10_000
#: Ids that are broadcast at most (some 16 bytes each); more are joined by shuffle.
MOST_BROADCAST_IDS = 1_000_000


#: Rows that go to Python at once: texts can be long, and workers share an executor's memory.
ARROW_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, the session's Arrow batches made small enough for long texts."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode and where none is configured."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = f"file://{tempfile.mkdtemp(prefix='helixframe-')}"
        spark.sparkContext.setCheckpointDir(there)
    return there


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts the lineage and computes once."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, however often body mentions it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(column: Column) -> Column:
    """A-Z alone become a-z."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hot_bound(total: int) -> int:
    """Rows from which on a key is hot: at most MOST_HOT keys can have as many."""
    return max(HOT_ROWS, -(-total // MOST_HOT))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of rows to groups, which has one row for each key with the number of its rows in `size`.

    Keys with hot_bound(total) rows or more, of which there are MOST_HOT at most, are joined by
    broadcast, where each row stays in its partition; all others by a shuffled join, whose keys are small.
    """
    bound = hot_bound(total)
    columns = [*rows.columns, *[c for c in groups.columns if c != key]]
    hot = rows.join(F.broadcast(groups.where(F.col(size) >= bound)), key).select(columns)
    names = groups.where(F.col(size) >= bound).select(key)
    cold = rows.join(F.broadcast(names), key, "left_anti").join(groups.where(F.col(size) < bound).hint("merge"), key).select(columns)
    return hot.unionByName(cold)


def digest(text: Column) -> Column:
    """SHA-256 of the text as it is, null as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def only_kept(documents: DataFrame, marked: DataFrame) -> DataFrame:
    """The rows of documents, all columns, that marked (doc_id, text_sha256, kept for each row) keeps.

    Of kept rows with one doc_id and one text a single one stays, whatever their other columns.  As a rule ids are
    distinct and go as ids: up to MOST_BROADCAST_IDS are broadcast, so that no text is shuffled.  Ids that some rows
    keep and others don't, and rows without an id, are told apart by their text's digest.
    """
    rows = marked.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
    by_id = rows.groupBy("doc_id").agg(F.max("stays").alias("any"), F.min("stays").alias("all"), F.max("n").alias("n"))
    ids = written(by_id.where(F.col("doc_id").isNull() | ~F.col("all") | (F.col("n") > 1)), "ids")
    own_gone, own_id, own_sha, own_text = unused(documents.columns, "gone", "id", "sha", "text")
    gone = ids.where(F.col("doc_id").isNotNull() & ~F.col("any")).select(F.col("doc_id").alias(own_gone))
    found = documents.join(_small(gone), documents["doc_id"] == F.col(own_gone), "left_anti")
    mixed = ids.where(F.col("doc_id").isNull() | F.col("any")).select(F.col("doc_id").alias(own_id))
    if mixed.isEmpty():
        return found
    pairs = written(marked.where("kept").join(mixed, F.col("doc_id").eqNullSafe(F.col(own_id)), "left_semi").select(F.col("doc_id").alias(own_id), F.col("text_sha256").alias(own_sha)).distinct(), "kept-pairs")
    is_mixed = documents["doc_id"].eqNullSafe(F.col(own_id))
    rest = found.join(_small(mixed), is_mixed, "left_anti")
    told = found.withColumn(own_text, digest(documents["text"]))
    told = told.join(_small(pairs, MOST_BROADCAST_IDS // 8), is_mixed & (F.col(own_text) == F.col(own_sha)), "left_semi")
    return rest.unionByName(told.dropDuplicates(["doc_id", own_text]).drop(own_text))


def unused(columns: list[str], *names: str) -> list[str]:
    """names, longer where columns (in any case) have them already."""
    taken, found = {c.lower() for c in columns}, []
    for name in names:
        name = f"own_{name}"
        while name in taken:
            name += "_"
        found.append(name)
    return found


def _small(keys: DataFrame, most: int = MOST_BROADCAST_IDS) -> DataFrame:
    """keys, to be broadcast if they are few enough."""
    return F.broadcast(keys) if keys.count() <= most else keys
