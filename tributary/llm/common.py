"""Shared plumbing: table reads, written cut points in the cluster's shared folder, safe column handling."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = 1000
HOT = 1000
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset in local mode (tests): a temporary one; unset on a cluster: an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tributary-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tributary-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lower_az(col):
    """Lower-case A-Z only; every other code point stays as it is."""
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def join_counted(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """rows joined to groups, one row a key, by `keys` (no nulls); groups' column `size` says how many of the `total` rows have the key.

    Keys of more than 1,000 rows and more than a 10,000th of all, so at most 10,000 keys, are broadcast, and their rows stay
    where they are; the others meet by shuffle, where no key has more than that.
    """
    bound = max(HOT, total // 10_000)
    hot = groups.filter(F.col(size) > bound)
    if hot.isEmpty():
        return rows.join(groups, keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(groups.filter(F.col(size) <= bound), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


def without_rows(docs: DataFrame, gone: DataFrame, row, bound: int = 500_000) -> DataFrame:
    """The rows of docs whose doc_id (null or not) and `row`, an expression on docs, aren't in gone (doc_id, row). Up to `bound` rows
    of gone, 16 bytes each, are broadcast; more are joined by a shuffle."""
    gone = stash(gone.select(F.col("doc_id").alias("_gone_id"), F.col("row").alias("_gone_row")).distinct(), "dropped")
    small = gone.limit(bound + 1).count() <= bound
    same = docs["doc_id"].cast("long").eqNullSafe(gone["_gone_id"]) & (row == gone["_gone_row"])
    return docs.join(F.broadcast(gone) if small else gone, same, "left_anti")


def small_table(spark: SparkSession, **columns: pa.Array) -> DataFrame:
    """A DataFrame of rows of the driver's, bounded by the caller, handed over as Arrow. A list of rows would go through plain
    Python workers, which stay on the executors beside the Arrow ones, with a daemon of their own."""
    return spark.createDataFrame(pa.table(columns))


def map_arrow(df: DataFrame, f, schema) -> DataFrame:
    """df.mapInArrow(f) with batches of at most 1,000 rows, as rows hold whole texts: less memory outside the heap and in the workers.

    Not on another map_arrow without a written cut or a shuffle between: each would hold a worker in every task, and workers stay.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(df.sparkSession.conf.get(key)) > BATCH:
        df.sparkSession.conf.set(key, str(BATCH))
    return df.mapInArrow(f, schema)
