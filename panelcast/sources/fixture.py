"""The fixture panel: a keyed daily panel derived from the test tables.

``lineitem`` joined to ``part`` (and, for the region key, to ``supplier``,
``nation`` and ``region``), grouped by ``(series, day)``.  Every column of
the reference's daily table has a stand-in (see FIXTURES.md):

    series  r_name (region key) or l_suppkey (supplier key)
    day     cast(l_shipdate as date)
    x_*     daily averages (measures), x_ret is null on days without returns
    y       count(*)                    (the target)
    y_drop  count(distinct l_orderkey)  (the column every study drops)

The plan is declarative: Catalyst prunes the scans to the columns used and
the aggregation runs partial (map-side) before the shuffle on the key, so
a key holding a third of all lineitem rows is combined inside each task.
The series of each supplier is broadcast while there are at most
``BROADCAST_ROWS`` suppliers: the planner takes a join for the product of its
sides, and would shuffle all of lineitem before it measures.  So is ``part``,
three numbers a row, up to ``PART_ROWS``; above, lineitem is shuffled once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEASURES = ["x_qty", "x_price", "x_disc", "x_tax", "x_size", "x_retail", "x_open", "x_ret"]
TARGET = "y"
DROPPED = "y_drop"
BROADCAST_ROWS = 1_000_000
PART_ROWS = 2_000_000
PANEL_COLUMNS = ["series", "day"] + MEASURES + [TARGET, DROPPED]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fixture_panel(spark: SparkSession, sf_dir: str, key: str = "region") -> DataFrame:
    """Daily panel keyed by ``(series, day)``; ``key`` is ``region`` or ``supplier``."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    if part.count() <= PART_ROWS:
        part = F.broadcast(part)
    if key == "region":
        sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
        nat = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
        reg = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
        geo = (sup.join(nat, sup.s_nationkey == nat.n_nationkey)
                  .join(reg, nat.n_regionkey == reg.r_regionkey)
                  .select("s_suppkey", F.col("r_name").alias("series")))
        if table(spark, sf_dir, "supplier").count() <= BROADCAST_ROWS:
            geo = F.broadcast(geo)
        base = li.join(geo, li.l_suppkey == geo.s_suppkey)
    elif key == "supplier":
        base = li.withColumn("series", F.col("l_suppkey"))
    else:
        raise ValueError(f"unknown panel key {key!r}")
    base = base.join(part, base.l_partkey == part.p_partkey)
    return (base.groupBy("series", F.col("l_shipdate").cast("date").alias("day"))
            .agg(F.avg("l_quantity").alias("x_qty"),
                 F.avg("l_extendedprice").alias("x_price"),
                 F.avg("l_discount").alias("x_disc"),
                 F.avg("l_tax").alias("x_tax"),
                 F.avg("p_size").cast("double").alias("x_size"),
                 F.avg("p_retailprice").alias("x_retail"),
                 F.avg(F.when(F.col("l_linestatus") == "O", 1).otherwise(0)).alias("x_open"),
                 F.avg(F.when(F.col("l_returnflag") == "R", F.col("l_discount"))).alias("x_ret"),
                 F.count(F.lit(1)).alias("y"),
                 F.countDistinct("l_orderkey").alias("y_drop")))
