"""Loading of the index tables and the rule for repeated deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table of a data set, as delivered."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def one_per_key(df: DataFrame, keys: list[str], columns: list[str], arrival: str = "loaded_at") -> DataFrame:
    """One record per key: the columns of the first delivery, with its ``arrival``; ties go to the smallest values.

    Rows whose key has a null are kept, one per distinct key. An empty input gives an empty result.
    """
    order = [arrival] if arrival in df.columns else []
    picked = F.min(F.struct(*order, *[c for c in columns if c not in keys and c not in order])).alias("_r")
    return df.groupBy(*keys).agg(picked).select(*keys, "_r.*")


def extension(path: Column) -> Column:
    """The extension of a path with its dot, or an empty string."""
    return F.regexp_extract(path, r"(\.[^./\\]+)$", 1)


def clean_path(path: Column) -> Column:
    """Slashes instead of backslashes, without a leading ``./``."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^\./", "")
