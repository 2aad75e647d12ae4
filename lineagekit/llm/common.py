"""What the operators of this subpackage share: the shared folder, written tables, components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE_ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when the driver found it by its own path."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if PACKAGE_ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([PACKAGE_ROOT, *paths])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only in local mode (tests, a laptop) is a temporary folder made and set where none is named.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("a cluster must name a shared folder in spark.checkpoint.dir")
        found = getattr(spark.sparkContext, "_lineagekit_shared", None)
        if not found:
            found = tempfile.mkdtemp(prefix="spark-lineagekit-")
            spark.sparkContext._lineagekit_shared = found
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as a Parquet table in the shared folder and read it again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_text(column: Column) -> Column:
    """Ids on their way to pandas, where numbers beside nulls would lose digits beyond 2^53."""
    return column.cast("long").cast("string")


def integers(values: Iterable) -> pd.Series:
    """Ids from texts, numbers and nulls, exact."""
    return pd.Series([None if v is None or v is pd.NA or v != v else int(v) for v in values], dtype="Int64")


class Forest:
    """Union-find over the edges that one task reads."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        p = self.parent
        p.setdefault(x, x)
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def add(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)

    def edges(self) -> pd.DataFrame:
        out = [(v, r) for v in list(self.parent) if (r := self.root(v)) != v]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def contracted(edges: DataFrame, most_vertices: int = 1_000_000) -> DataFrame:
    """Edges with the same components, at most one a vertex of each task: each task joins what it
    reads to its smallest vertex, and begins anew beyond ``most_vertices``. No shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = Forest()
        for frame in frames:
            for a, b in zip(frame["a"].tolist(), frame["b"].tolist()):
                forest.add(a, b)
            if len(forest.parent) > most_vertices:
                yield forest.edges()
                forest = Forest()
        yield forest.edges()

    return edges.select("a", "b").mapInPandas(run, "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest id reachable from each vertex of ``edges`` (a, b); rows (id, component).

    Alternates large-star and small-star steps until no edge changes, each after the edges that a
    task reads are contracted in it. Each step links every
    neighbour to the smallest one, so a vertex with many links is handled by a grouped minimum
    and a join, never by one list in a task. Every step is written to the shared folder.
    Vertices without an edge have no row. Empty input: no rows. Null ends and loops are left out.
    """
    given = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"), "edges")
    work, last = written(contracted(given), "edges"), None
    for _ in range(rounds):
        # large-star: for each vertex, its larger neighbours point at the smallest of all
        both = work.union(work.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small-star: smaller neighbours and the vertex itself point at the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
        stars = written(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            work = stars
            break
        last, work = now, contracted(stars)
    else:
        raise RuntimeError("components did not settle")
    low = work.groupBy("a").agg(F.min("b").alias("component")).toDF("id", "component")
    return low.union(low.select("component", "component").distinct())
