"""Session helpers: table access, lineage cuts, hot-key joins and size-checked broadcasts."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python workers import it; needed where it is not installed there. The
    packages it needs (pyproject.toml) must be."""
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="libroflow-ship-")  # the driver's own: Spark copies the file to each executor
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/libroflow", "zip", root.parent, root.name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _checkpoint_ready(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="libroflow-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder of spark.checkpoint.dir (an own folder only in local mode)."""
    spark = df.sparkSession
    _checkpoint_ready(spark)
    done = df.checkpoint(eager=True)
    # a checkpoint keeps the size estimate and constraints of its plan; a join's estimate is the product of its
    # sides', so over the rounds of an iteration they grow without bound and planning stalls. Start them afresh.
    fresh = DataFrame(spark._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False), spark)
    file = done._jdf.queryExecution().logical().rdd().getCheckpointFile()
    fresh._stored = file.get() if file.isDefined() else None
    return fresh


def drop(*frames: DataFrame) -> None:
    """Delete what `cut` stored of tables that nothing reads any more, without waiting for the driver's garbage."""
    for df in frames:
        if stored := getattr(df, "_stored", None):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(stored)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def apart(spark: SparkSession, adaptive: bool = False) -> SparkSession:
    """A session of its own on the same cluster, whose queries end in `cut`: the files of their exchanges go as soon as each
    has run. For an iteration its plans are static, and its exchanges are sized by `sized`: adaptive planning would give
    each of the many small exchanges a driver thread that stays for a minute. Otherwise they are as many as the caller's.
    The caller's session and the queries running in it are not touched."""
    own = spark.newSession()
    own.conf.set("spark.sql.adaptive.enabled", str(adaptive).lower())
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return own


def moved(df: DataFrame, spark: SparkSession) -> DataFrame:
    """A checkpointed table in another session of the same cluster."""
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False), spark)


def sized(spark: SparkSession, rows: int, few: int = 50_000, many: int = 2_000_000) -> None:
    """Exchanges of a session of one's own fit `rows`: a task for each `few` rows until all cores have three, then
    one for each `many`."""
    n = max(min(rows // few, 3 * spark.sparkContext.defaultParallelism), rows // many)
    spark.conf.set("spark.sql.shuffle.partitions", str(n + 1))


def hot_keys(counts: DataFrame, key: str, n: str, rows: int, share: int = 200, floor: int = 20_000) -> DataFrame:
    """The keys that hold more than rows/share (and `floor`) of the `rows` rows: at most `share` of them."""
    return counts.filter(F.col(n) > max(rows // share, floor)).select(F.col(key).alias("_hot"))


def hot_lookup(left: DataFrame, key: str, right: DataFrame, right_key: str, rows: int, share: int = 200, salts: int = 32, floor: int = 20_000, hot: DataFrame | None = None) -> DataFrame:
    """Left join of `left` to `right`, whose `right_key` is unique, safe when few keys hold most of `left`.

    A key is hot when it holds more than rows/share (and `floor`) of the `rows` left rows, so there are at most
    `share` hot keys. Their left rows are spread over `salts` salts and their right rows repeated for each; below
    `floor` rows in all nothing can be hot and the join is a plain one (the plan differs, the result does not).
    hot: the hot keys where the caller knows them, in a column `_hot`.
    """
    if rows <= floor:
        return left.join(right, F.col(key) == F.col(right_key), "left")
    if hot is None:
        left = cut(left)  # read twice: for the counts and for the join
        hot = hot_keys(left.groupBy(F.col(key).alias("_k")).count(), "_k", "count", rows, share, floor)
    salted = left.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")).otherwise(0)).drop("_hot")
    last = F.when(F.col("_hot").isNotNull(), salts - 1).otherwise(0)
    spread = right.join(F.broadcast(hot), F.col(right_key) == F.col("_hot"), "left").withColumn("_copy", F.explode(F.sequence(F.lit(0), last))).drop("_hot")
    return salted.join(spread, (F.col(key) == F.col(right_key)) & (F.col("_salt") == F.col("_copy")), "left").drop("_salt", "_copy")


def small(df: DataFrame, max_rows: int, max_bytes: int = 64 << 20) -> list | None:
    """Rows of `df` if it has at most `max_rows` rows of at most `max_bytes` of text in all, else None.

    The bound is checked by an aggregation before anything is sent to the driver.
    """
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns), F.lit(0))
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return df.collect() if n <= max_rows and size <= max_bytes else None


def bounded(df: DataFrame, what: str, max_rows: int, max_bytes: int = 64 << 20) -> list:
    """Rows of `df`, which by the way it is made has at most `max_rows` rows; an error where they are too large to
    send around, never a shorter list."""
    rows = small(df, max_rows, max_bytes)
    if rows is None:
        raise ValueError(f"{what}: more than {max_rows} rows or {max_bytes} bytes")
    return rows
