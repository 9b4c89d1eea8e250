"""Session defaults, shared scratch storage and size-checked broadcasts.

Everything that must outlive a task (materialised levels, text written for
round trips) goes below the folder the cluster names in
``spark.checkpoint.dir``.  Only when no such folder is configured *and*
the master is local (tests, a laptop) do we create one ourselves.
"""

from __future__ import annotations

import contextlib
import logging
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Settings a caller should run with; `session()` applies them for tests and
# the bench.  AQE re-plans joins at runtime (broadcast when a side turns out
# small, split skewed partitions of inner joins on both sides).
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Level tables and occurrence joins are small in bytes but costly per
    # row (array keys); do not let AQE squeeze them into one or two tasks.
    # No effect at scale, where every shuffle partition is far larger.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str = "local[8]", shuffle_partitions: int = 8,
            app_name: str = "basketmine", extra: dict | None = None) -> SparkSession:
    builder = (SparkSession.builder.master(master).appName(app_name)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "8g"))
    for key, value in {**RECOMMENDED_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, local_dir: str | None = None) -> str:
    """The cluster's shared checkpoint folder.

    Where none is set, only a local master gets one: `local_dir`, or else a
    new temporary folder, of which the log tells.
    """
    sc = spark.sparkContext
    path = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a folder every "
            "executor can reach (HDFS, S3, a shared mount)")
    path = local_dir or tempfile.mkdtemp(prefix="basketmine-cp-")
    logging.getLogger(__name__).warning("spark.checkpoint.dir is not set; using %s", path)
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir().rstrip("/")


_scopes: list[str] = []      # open scratch scopes, innermost last


def _app_scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/basketmine/{spark.sparkContext.applicationId}"


def new_scratch(spark: SparkSession, label: str = "run") -> str:
    """A fresh folder below the shared checkpoint folder, in the innermost open scope."""
    base = _scopes[-1] if _scopes else _app_scratch(spark)
    return f"{base}/{label}-{uuid.uuid4().hex[:12]}"


@contextlib.contextmanager
def scratch_scope(spark: SparkSession, label: str = "scope"):
    """Deletes everything that `new_scratch` handed out inside the block.

    For work that ends inside the block, such as one that writes its results:
    a DataFrame built inside cannot be read after it.
    """
    path = new_scratch(spark, label)
    _scopes.append(path)
    try:
        yield path
    finally:
        _scopes.remove(path)
        delete_path(spark, path)


def free_scratch(spark: SparkSession) -> None:
    """Delete all scratch folders of this application (once its results are no longer read)."""
    delete_path(spark, _app_scratch(spark))


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write `df` as parquet on shared storage and read it back.

    Cuts the lineage (a lost executor re-reads files instead of re-running
    the level loop) and gives the optimizer exact file sizes for its
    broadcast decisions.  One job, no double computation.
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_measured(df: DataFrame, path: str, aggregates: list) -> tuple[DataFrame, dict]:
    """`materialize`, with aggregates over the rows taken in flight by the same job."""
    seen = Observation()
    return materialize(df.observe(seen, *aggregates), path), seen.get


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder on whatever file system holds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def broadcast_limit(spark: SparkSession) -> int:
    """Byte limit for explicit broadcasts: the session's own threshold."""
    raw = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    raw = raw.strip().lower().rstrip("b")
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    if raw and raw[-1] in units:
        return int(float(raw[:-1]) * units[raw[-1]])
    return int(raw)


def set_bytes(items) -> "F.Column":
    """Upper bound of the in-memory size of a set column.

    Per member the larger of its text's bytes and 8 is at most bytes + 8, so
    the joined text plus 8 bytes per member (plus array overhead) bounds it;
    built-in, code-generated functions only.
    """
    text = F.array_join(items.cast("array<string>"), ",")
    return (F.lit(16) + F.coalesce(F.octet_length(text), F.lit(0))
            + F.lit(8) * F.coalesce(F.size(items), F.lit(0))).cast("long")


TASK_ROWS = 250_000  # rows of rating files that one task sorts
ROW_OVERHEAD = 64    # row header, support and count columns, hash-table entry


def row_bytes(*set_cols) -> "F.Column":
    """Upper bound of one row holding the given set columns and a few numbers."""
    out = F.lit(ROW_OVERHEAD).cast("long")
    for c in set_cols:
        out = out + set_bytes(F.col(c) if isinstance(c, str) else c)
    return out


def key_bytes(df: DataFrame, cols: list[str]) -> "F.Column":
    """Upper bound of one row holding `cols` of `df`: sets, text or numbers."""
    out = F.lit(ROW_OVERHEAD).cast("long")
    for c in cols:
        kind = df.schema[c].dataType.typeName()
        if kind == "array":
            out = out + set_bytes(F.col(c))
        else:
            out = out + F.lit(16) + F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))
    return out


def can_broadcast(spark: SparkSession, n_bytes: int) -> bool:
    """Is a measured size bound within the session's broadcast threshold?"""
    return 0 <= n_bytes <= broadcast_limit(spark)


def maybe_broadcast(df: DataFrame, n_bytes: int) -> DataFrame:
    """Broadcast `df` only when its measured size bound is small.

    `n_bytes` is an upper bound computed from the data itself (sum of
    `row_bytes` over all rows, taken in the same job that counts them).
    Above the session's broadcast threshold the frame is returned as is and
    Spark plans a shuffle join (AQE may still broadcast it after measuring
    the real shuffle size).
    """
    return F.broadcast(df) if can_broadcast(df.sparkSession, n_bytes) else df
