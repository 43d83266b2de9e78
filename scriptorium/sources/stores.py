"""Relational and graph stores.

A7 reads and writes the ledger over JDBC with a partitioned read; it needs a reachable database,
which this build does not start, so it is not part of the registered queries. A9 exports node and
edge tables to files and imports them back with explicit schemas, validating edge endpoints.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_ledger_jdbc(spark: SparkSession, url: str, table: str = "tasks", partitions: int = 8,
                     bounds: tuple[int, int] | None = None, partition_column: str = "retry_count",
                     props: dict | None = None) -> DataFrame:
    """Partitioned JDBC read (one range query per partition)."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in (props or {}).items():
        r = r.option(k, v)
    if bounds:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", bounds[0])
             .option("upperBound", bounds[1]).option("numPartitions", partitions))
    return r.load()


def write_ledger_jdbc(df: DataFrame, url: str, table: str = "tasks", mode: str = "append",
                      batch_size: int = 10_000, props: dict | None = None) -> None:
    """Batched JDBC append; parallelism = number of partitions of ``df``."""
    w = df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batch_size)
    for k, v in (props or {}).items():
        w = w.option(k, v)
    w.mode(mode).save()


NODE_SCHEMA = T.StructType([T.StructField("node_id", T.StringType()), T.StructField("label", T.StringType()),
                            T.StructField("name", T.StringType())])
EDGE_SCHEMA = T.StructType([T.StructField("src", T.StringType()), T.StructField("dst", T.StringType()),
                            T.StructField("rel", T.StringType())])


def graph_from_tables(customer: DataFrame, nation: DataFrame, region: DataFrame) -> tuple[DataFrame, DataFrame]:
    nodes = (customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node_id"),
                             F.lit("Customer").alias("label"), F.col("c_name").alias("name"))
             .unionByName(nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node_id"),
                                        F.lit("Nation").alias("label"), F.col("n_name").alias("name")))
             .unionByName(region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node_id"),
                                        F.lit("Region").alias("label"), F.col("r_name").alias("name"))))
    edges = (customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("src"),
                             F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("dst"),
                             F.lit("IN_NATION").alias("rel"))
             .unionByName(nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"),
                                        F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("dst"),
                                        F.lit("IN_REGION").alias("rel"))))
    return nodes, edges


def export_graph(nodes: DataFrame, edges: DataFrame, path: str, fmt: str = "json") -> None:
    """Node and edge files (JSON lines or CSV with header)."""
    w_opts = {"header": "true"} if fmt == "csv" else {}
    nodes.write.mode("overwrite").options(**w_opts).format(fmt).save(os.path.join(path, "nodes"))
    edges.write.mode("overwrite").options(**w_opts).format(fmt).save(os.path.join(path, "edges"))


def import_graph(spark: SparkSession, path: str, fmt: str = "json") -> tuple[DataFrame, DataFrame]:
    """Read back with explicit schemas; each edge gets ``valid`` = both endpoints exist
    (two semi-join flags via left joins on node ids, so dangling edges are kept and reported)."""
    r_opts = {"header": "true"} if fmt == "csv" else {}
    nodes = spark.read.schema(NODE_SCHEMA).options(**r_opts).format(fmt).load(os.path.join(path, "nodes"))
    edges = spark.read.schema(EDGE_SCHEMA).options(**r_opts).format(fmt).load(os.path.join(path, "edges"))
    ids = nodes.select("node_id").distinct()
    e = (edges.join(ids.withColumnRenamed("node_id", "src").withColumn("_s", F.lit(True)), "src", "left")
         .join(ids.withColumnRenamed("node_id", "dst").withColumn("_d", F.lit(True)), "dst", "left")
         .withColumn("valid", F.coalesce("_s", F.lit(False)) & F.coalesce("_d", F.lit(False)))
         .drop("_s", "_d"))
    return nodes, e
