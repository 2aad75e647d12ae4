"""Sessions and table access."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(name: str = "lineagekit", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A UTC session with adaptive execution; cluster settings given elsewhere stay."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", shuffle_partitions)
    return builder.getOrCreate()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"no table {name}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the folder that the cluster shares (``spark.checkpoint.dir``): what is used twice
    is then the same both times, and an executor that is lost takes nothing with it.

    Only in local mode (tests, a laptop) a temporary one is made where none is named.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise RuntimeError("a cluster must name a shared folder in spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-lineagekit-"))
    return df.checkpoint()


def rounded(value: Column, digits: int = 6) -> Column:
    """Half up towards positive infinity, as floor(x * 10^n + 0.5) / 10^n."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A rule table: data of this package, of a size known when it is written."""
    return spark.createDataFrame(rows, schema)
