"""What depends on the Spark session: shipping the package to Python workers, the shared folder, size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's source to the executors, once for each Spark application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if root.endswith((".zip", ".egg")) or ".zip" + os.sep in root:
        return
    at = os.path.join(tempfile.mkdtemp(prefix="seqloom-src-"), "seqloom_src.zip")
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    p = os.path.join(folder, f)
                    z.write(p, os.path.relpath(p, os.path.dirname(root)))
    sc.addPyFile(at)
    _shipped.add(sc.applicationId)


_local: dict[str, str] = {}
#: Rows of a narrow table that may be sent to every executor.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary one, in local mode only."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "at" not in _local:
        _local["at"] = tempfile.mkdtemp(prefix="seqloom-")
        atexit.register(shutil.rmtree, _local["at"], ignore_errors=True)
    return f"file://{_local['at']}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/seqloom-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read again, which cuts its lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A written or cheap narrow table, marked for broadcast if its rows allow that; else a join shuffles and sorts it, whatever the size
    of its files makes Spark think: a written table takes up to a hundred times as much memory as disk."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df.hint("merge")


#: An item that is in over this share of all places is sent to every task instead of one.
HOT_SHARE = 1000


def join_items(each: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """Left join of a row for each place with what a table has for each item, once (key, value; missing items get null).

    Item frequencies are skewed, so hot items (fewer than HOT_SHARE of them can be) are broadcast, and only the others are shuffled.
    """
    n = each.count()
    if table.count() <= HOT_SHARE:
        return each.join(F.broadcast(table), key, "left")
    hot = written(each.groupBy(key).count().where(F.col("count") * HOT_SHARE > n).select(key), "hot")
    frequent = table.join(F.broadcast(hot), key, "left_semi").select(key, F.col(value).alias("__hot"), F.lit(True).alias("__is_hot"))
    marked = each.join(F.broadcast(frequent), key, "left")
    rest = marked.where("__is_hot IS NULL").drop("__hot", "__is_hot").join(table.select(key, value), key, "left")
    return marked.where("__is_hot").withColumnRenamed("__hot", value).select(*rest.columns).unionByName(rest)
