"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where a session without spark.checkpoint.dir may write: only on a master in one process, as in tests.
LOCAL_ROOT = "file:///tmp/checkpoints"
#: At most so many keys are treated as hot, so that a list of them can be broadcast.
HOT_KEYS = 50_000
#: A key of fewer rows isn't hot, and a hot key's rows are dealt over so many salts.
HOT_ROWS, SALTS = 1024, 64

#: Tables that materialize() wrote in this process and drop() hasn't deleted.
_written: list[DataFrame] = []


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a folder of our own is set only where the session has none and runs in one
    process. On a cluster without the setting this raises, since the executors share no local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = set_dir.get() if set_dir.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = LOCAL_ROOT
    return root.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again.

    This cuts the lineage, so that a lost executor costs a reread instead of a recomputation, and a table that is used
    twice is computed once. drop() deletes it; otherwise it lives as long as the shared folder.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folianth_path = path
    _written.append(out)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote and that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_folianth_path", None)
        if path:
            _written[:] = [w for w in _written if w is not t]
            jvm, conf = t.sparkSession._jvm, t.sparkSession._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def written() -> list[DataFrame]:
    """The tables that are there now; what a step leaves behind is what is written after it and not before."""
    return list(_written)


def hot_keys(rows: DataFrame, key: str, n_rows: int) -> DataFrame:
    """The keys of at least HOT_ROWS and n_rows / HOT_KEYS rows; there are at most HOT_KEYS of them."""
    return materialize(rows.groupBy(key).count().where(F.col("count") >= max(HOT_ROWS, n_rows // HOT_KEYS)).select(key), "hot")


def hot_join(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Inner join of rows with a table of few rows a key, where the hot keys may hold a large share of the rows.

    The list of hot keys is broadcast, their rows are dealt over SALTS keys, and the table's rows for them are repeated
    for each salt.
    """
    hot = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")
    left = rows.join(hot, key, "left").withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(0)).drop("_hot")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = table.join(hot, key, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return left.join(right, [key, "_salt"]).drop("_salt")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
