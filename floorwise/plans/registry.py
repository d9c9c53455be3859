"""Queries on the driver's tables and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query builder under ``name``, with its SQL where there is one."""

    def add(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "integrity_report",
    """
    SELECT 'lineitem.order' AS rule, 'ERROR' AS severity, count(*) AS findings FROM lineitem l
    WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'F')
    UNION ALL
    SELECT 'orders.customer', 'WARNING', count(*) FROM orders o
    WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal > 0)
    """,
)
def integrity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that miss a restricted target, counted by rule."""
    lines, orders, customers = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    final = orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    solvent = customers.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    missing = lines.select("l_orderkey").join(final, "l_orderkey", "left_anti")
    ownerless = orders.select("o_custkey").join(solvent, "o_custkey", "left_anti")
    counted = lambda df, rule, severity: df.agg(F.count("*").alias("findings")).select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "findings")
    return counted(missing, "lineitem.order", "ERROR").unionByName(counted(ownerless, "orders.customer", "WARNING"))
