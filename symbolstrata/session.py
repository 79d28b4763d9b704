"""Session building and the two helpers that every multi-stage operator shares."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "8", app: str = "symbolstrata", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.sql.shuffle.partitions": cores,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, use: str) -> str:
    """The folder that all executors share, as the session names it in ``spark.checkpoint.dir``.

    Only a local session without one (tests) gets a temporary folder; on a cluster that would break, so it raises.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir")
    if named:
        return named
    if not conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix=f"spark-{use}-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and read it from there; the files outlive the executors that wrote them."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession, "checkpoint"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str, keep: bool = False) -> DataFrame:
    """``df``, a scan, in as many partitions as the session has cores if its files give fewer; else as it is.

    Tables of a few files or row groups would otherwise leave the work on them to a few tasks. ``keys`` tell rows apart;
    with ``keep`` the spread rows are written once for several readers.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    wide = df.repartition(cores, *keys)
    return cut_lineage(wide) if keep else wide


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark ``df`` for broadcast only if its counted rows are at most ``max_rows``; beyond that Spark shuffles it.

    Call it on something cheap to count (a checkpointed or written frame) with narrow rows.
    """
    return F.broadcast(df) if df.count() <= max_rows else df


#: Rows of one key that a task of a split join gets at most, about; narrow sides of up to BROADCAST_ROWS rows are broadcast.
SPLIT_ROWS, BROADCAST_ROWS = 20_000, 2_000_000


def split_join(left: DataFrame, right: DataFrame, keys: list[str], split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Inner join whose hot keys don't meet in one task: keys with more than ``split_rows`` rows on the right are parted there
    by a hash of the row, and the left rows go to each part. The keys' rows are counted first, pre-aggregated."""
    hot = right.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > split_rows)
    hot = cut_lineage(hot.select(*keys, F.ceil(F.col("_n") / split_rows).cast("int").alias("_parts")))
    if hot.isEmpty():
        return left.join(right, keys)
    hot = small_side(hot, BROADCAST_ROWS)
    parts = F.coalesce("_parts", F.lit(1))
    parted = right.join(hot, keys, "left").withColumn("_part", F.pmod(F.xxhash64(*right.columns), parts).cast("int")).drop("_parts")
    copied = left.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return copied.join(parted, [*keys, "_part"]).drop("_part")


_shipped: dict[str, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by the Python workers of the session's executors, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        here = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="symbolstrata-")
        target = Path(folder, "symbolstrata.zip")
        with zipfile.ZipFile(target, "w") as archive:
            for source in sorted(here.rglob("*.py")):
                archive.write(source, source.relative_to(here.parent))
        context.addPyFile(str(target))
        _shipped[context.applicationId] = str(target)
