"""Net revenue and order count per customer nation and order year."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.sources.tables import read_table


def _hundredths(name: str) -> Column:
    """The column in whole hundredths; null stays null, a value with more than two decimals is refused."""
    scaled = F.col(name) * 100
    whole = F.rint(scaled)
    return F.when(
        F.abs(scaled - whole) >= 1e-4,
        F.raise_error(F.concat(F.lit(f"{name} has more than two decimals: "), F.col(name).cast("string"))).cast("long"),
    ).otherwise(whole.cast("long"))


def revenue_by_nation_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (nation name, year) over all of lineitem, orders and customer.

    o_orderkey, c_custkey and n_nationkey must be keys of their tables: a
    repeated order row would count twice. Nations of one name count together.

    Each join key is aggregated before it is joined on. Partial aggregation
    then folds a hot order or customer into at most one row per map task and
    (key, year), so skew in either key never reaches a join. The order
    aggregate and the orders join share one hash partitioning on the order
    key. No side is hinted: Spark broadcasts customer or nation only when its
    own size estimate is under spark.sql.autoBroadcastJoinThreshold.

    Prices and discounts hold two decimals; others are refused, not rounded.
    They become whole cents and whole percents, whose product is summed as a
    decimal: exact, independent of row order, and without the costly
    double-to-decimal cast on every line.
    """
    cents = _hundredths("l_extendedprice")
    percent_paid = 100 - _hundredths("l_discount")
    per_order = (
        read_table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.sum((cents * percent_paid).cast("decimal(18,0)")).alias("revenue"))
    )
    per_customer = (
        read_table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("o_year"))
        .join(per_order, "o_orderkey")
        .groupBy("o_custkey", "o_year")
        .agg(F.sum("revenue").alias("revenue"), F.count("*").alias("n_orders"))
    )
    per_nation = (
        read_table(spark, sf_dir, "customer")
        .select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
        .join(per_customer, "o_custkey")
        .groupBy("c_nationkey", "o_year")
        .agg(F.sum("revenue").alias("revenue"), F.sum("n_orders").alias("n_orders"))
    )
    revenue = F.sum("revenue") * F.lit(Decimal("0.0001"))
    return (
        read_table(spark, sf_dir, "nation")
        .select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
        .join(per_nation, "c_nationkey")
        .groupBy("n_name", "o_year")
        .agg(F.sum("n_orders").alias("n_orders"), revenue.cast("double").alias("revenue"))
    )


REVENUE_BY_NATION_YEAR_SQL = """
SELECT n_name,
       CAST(year(o_orderdate) AS INTEGER) AS o_year,
       count(DISTINCT o_orderkey) AS n_orders,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))
                * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name, year(o_orderdate)
"""
