"""Readers for the raw tables.

Tests and the bench read Parquet files; a deployment reads the same schemas from a
warehouse table or a partitioned JDBC source.  Column pruning and predicate pushdown
happen in the scan, so readers select nothing eagerly.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


#: Schemas of the relational tables: with them a read opens no footer before the query runs.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
                "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``{sf_dir}/{name}.parquet`` (a file or a directory of part files); other tables than those of ``SCHEMAS`` bring theirs."""
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(os.path.join(sf_dir, f"{name}.parquet"))


class Tables:
    """Lazy accessor: ``Tables(spark, dir).orders`` reads ``orders.parquet`` once per instance."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._cache = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLES:
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = read_table(self.spark, self.sf_dir, name)
        return self._cache[name]


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str,
              lower: int, upper: int, num_partitions: int, properties: dict | None = None) -> DataFrame:
    """Partitioned JDBC read (one range query per partition, run by executors)."""
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower, upperBound=upper,
                           numPartitions=num_partitions, properties=properties or {})


# Explicit schemas of the CSV exports (no inference on large inputs).
VENDORS_CSV_SCHEMA = T.StructType([
    T.StructField("vendor_id", T.LongType(), False),
    T.StructField("city", T.StringType(), True),
    T.StructField("category", T.StringType(), True),
    T.StructField("rating", T.DoubleType(), True),
    T.StructField("created_at", T.TimestampType(), True),
])

ALERTS_CSV_SCHEMA = T.StructType([
    T.StructField("customer_id", T.StringType(), False),
    T.StructField("city", T.StringType(), True),
    T.StructField("segment", T.StringType(), True),
    T.StructField("plan_type", T.StringType(), True),
    T.StructField("churn_probability", T.DoubleType(), True),
    T.StructField("run_ts", T.TimestampType(), True),
])

IMPORTANCE_CSV_SCHEMA = T.StructType([
    T.StructField("feature", T.StringType(), False),
    T.StructField("importance", T.DoubleType(), True),
])


def read_csv(spark: SparkSession, path: str, schema: T.StructType, encoding: str = "UTF-8",
             timestamp_format: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """CSV export with a header row, read with an explicit schema."""
    return (spark.read.option("header", True).option("encoding", encoding)
            .option("timestampFormat", timestamp_format).schema(schema).csv(path))
