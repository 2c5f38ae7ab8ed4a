"""Stored collections: created, listed, described, indexed and dropped through the catalog."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow import model
from folioflow.operators import vectors
from folioflow.operators.store import CorpusStore

PREFIX = "papers_eval_"
INDEX_PROPERTY = "folioflow.index"


def name_of(strategy: str) -> str:
    return f"{PREFIX}{strategy}"


def exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def collections(spark: SparkSession, prefix: str = PREFIX) -> list[str]:
    """Names of the stored collections, sorted."""
    return sorted(t.name for t in spark.catalog.listTables() if t.name.startswith(prefix))


def drop(spark: SparkSession, name: str) -> bool:
    """Drops a collection; False if there was none."""
    there = exists(spark, name)
    spark.sql(f"drop table if exists `{name}`")
    return there


def write(rows: DataFrame, name: str, index: str = "FLAT", replace: bool = True, vec_col: str = "vectors", cells: int | None = None) -> DataFrame:
    """Stores a collection with its index kind; ValueError for an unknown kind.

    IVF_FLAT stores rows by the cell of their nearest centre, so that a probe reads
    only its cells; rows without a vector go to cell -1. Other kinds are scans.
    """
    if index not in model.INDEXES:
        raise ValueError(f"unknown index {index}; known: {', '.join(model.INDEXES)}")
    spark = rows.sparkSession
    if replace:
        drop(spark, name)
    if index == "IVF_FLAT":
        with_vector = rows.filter(F.col(vec_col).isNotNull())
        indexed, fitted = vectors.build_ivf(with_vector, cells or model.INDEXES[index][0]["nlist"], vec_col)
        rest = rows.filter(F.col(vec_col).isNull()).withColumn("cell", F.lit(-1))
        indexed.unionByName(rest).write.partitionBy("cell").mode("append").saveAsTable(name)
        centres = [(i, [float(x) for x in c]) for i, c in enumerate(fitted.clusterCenters())]
        spark.createDataFrame(centres, "cell int, centre array<double>").write.mode("overwrite").saveAsTable(f"{name}__centres")
    else:
        rows.write.mode("append").saveAsTable(name)
    spark.sql(f"alter table `{name}` set tblproperties ('{INDEX_PROPERTY}' = '{index}')")
    return spark.table(name)


def index_of(spark: SparkSession, name: str) -> str:
    """Index kind of a stored collection, FLAT if none is noted."""
    found = spark.sql(f"show tblproperties `{name}`").filter(F.col("key") == INDEX_PROPERTY).head()
    return found["value"] if found else "FLAT"


def rebuild(spark: SparkSession, name: str, index: str, cells: int | None = None) -> DataFrame:
    """The same rows under another index kind, copied aside, so that a failure loses nothing."""
    rows = spark.table(name)
    rows = rows.drop("cell") if "cell" in rows.columns else rows
    aside = f"{name}__aside"
    write(rows, aside)
    made = write(spark.table(aside), name, index, cells=cells)
    drop(spark, aside)
    return made


def describe(spark: SparkSession, name: str) -> DataFrame:
    """(name, total_records, total_papers, index_type) of a stored collection."""
    return CorpusStore(spark.table(name)).stats().select(F.lit(name).alias("name"), "total_records", "total_papers", F.lit(index_of(spark, name)).alias("index_type"))


_STORES: dict[str, Callable[[SparkSession, str], CorpusStore]] = {
    "table": lambda spark, at: CorpusStore(spark.table(at)),
    "parquet": lambda spark, at: CorpusStore(spark.read.parquet(at)),
}


def open_store(spark: SparkSession, provider: str, at: str) -> CorpusStore:
    """A store by the name of its provider; ValueError for an unknown one."""
    if provider not in _STORES:
        raise ValueError(f"unknown provider {provider}; known: {', '.join(sorted(_STORES))}")
    return _STORES[provider](spark, at)
