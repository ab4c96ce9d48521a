"""Sources that are scanned by JDBC, against a database that Spark brings along, in the memory of this process."""

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from tidewell.operators.anomalies import tukey_distance
from tidewell.plans import apps
from tidewell.sources.readers import read

URL = "jdbc:derby:memory:tidewell"
DRIVER = "org.apache.derby.jdbc.EmbeddedDriver"
SCAN = {"ds.name": "ignite", "ds.driver": DRIVER, "ds.url": URL}


@pytest.fixture(scope="module")
def orders(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice")
    rows = rows.withColumn("o_skewed", F.when(F.col("o_orderkey") % 3 == 0, 7).when(F.col("o_orderkey") % 10 != 1, F.col("o_orderkey")))
    rows = rows.toDF(*[c.upper() for c in rows.columns])  # names without quotes are upper case there
    rows.coalesce(1).write.mode("overwrite").jdbc(f"{URL};create=true", "ORDERS", properties={"driver": DRIVER})
    return rows.cache()


def same(a, b):
    a, b = (sorted(map(tuple, x.collect()), key=repr) for x in (a, b))
    assert a == b and a


def test_tables_and_statements(spark, orders):
    same(read(spark, SCAN | {"ds.table": "ORDERS"}), orders)
    found = read(spark, SCAN | {"ds.sql": "SELECT O_ORDERKEY, O_TOTALPRICE FROM ORDERS WHERE O_ORDERKEY > 100"})
    same(found, orders.where("o_orderkey > 100").select("o_orderkey", "o_totalprice"))
    assert found.schema.names == ["O_ORDERKEY", "O_TOTALPRICE"]


def test_filters_and_columns_reach_the_database(spark, orders):
    plan = read(spark, SCAN | {"ds.table": "ORDERS"}).where("O_ORDERKEY = 7").select("O_TOTALPRICE")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(O_ORDERKEY,7)" in plan and "O_ORDERSTATUS" not in plan


def test_scans_split_by_bounds(spark, orders):
    found = read(spark, SCAN | {"ds.table": "ORDERS", "ds.column": "O_ORDERKEY", "ds.lower": "1", "ds.upper": "1500", "ds.partitions": "3"})
    assert found.rdd.getNumPartitions() == 3
    same(found, orders)


@pytest.mark.parametrize("keys", [None, "SELECT O_SKEWED FROM ORDERS WHERE O_ORDERKEY > 50"])
def test_balanced_scans_hold_equal_shares(spark, orders, keys):
    """A third of the rows share one value and some have none; all rows come, and no other partition gets much more than its share."""
    settings = SCAN | {"ds.table": "ORDERS", "ds.column": "O_SKEWED", "ds.balance": "6"} | ({"ds.keys": keys} if keys else {})
    found = read(spark, settings)
    same(found, orders)
    sizes = found.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.countDistinct("O_SKEWED").alias("d")).collect()
    assert max(r.n for r in sizes if r.d > 1) <= 1.5 * orders.count() / 6


def test_applications_on_a_database(spark, orders):
    settings = SCAN | {"ds.sql": "SELECT O_ORDERKEY, O_TOTALPRICE FROM ORDERS", "anon.model": "tukey", "anon.value": "O_TOTALPRICE"}
    same(apps.anomalies(spark, settings), tukey_distance(orders.select("O_ORDERKEY", "O_TOTALPRICE"), "O_TOTALPRICE"))


def test_faults(spark, orders):
    with pytest.raises(NotImplementedError):
        read(spark, {"ds.name": "ignite", "ds.url": URL, "ds.table": "ORDERS"})
    with pytest.raises(ValueError):
        read(spark, SCAN)
    with pytest.raises(ValueError):
        read(spark, {"ds.name": "other"})
    with pytest.raises(Py4JJavaError, match="does not exist"):
        read(spark, SCAN | {"ds.table": "NOTHING"})
