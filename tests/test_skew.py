"""Joins on skewed keys: results against the plain join, and how evenly the rows
lie over the tasks, without adaptive execution."""

import statistics

import pytest
from pyspark.sql import functions as F

from revlens.operators.profiling import distinct_counts
from revlens.operators.relational import heavy_hitter_join, heavy_keys

PARTS = 16


@pytest.fixture()
def plain_shuffles(spark):
    """No adaptive execution, no broadcast by size, ``PARTS`` partitions."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold",
                                           "spark.sql.shuffle.partitions")}
    for k, v in zip(held, ("false", "-1", str(PARTS))):
        spark.conf.set(k, v)
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


@pytest.fixture()
def orders(spark):
    """60,000 rows: a third of one town, a sixth without a town, the rest even."""
    return spark.range(60_000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(
        F.col("id") % 6 == 1, None).otherwise(F.concat(F.lit("t"), F.col("id") % 4_001)).alias("town"))


@pytest.fixture()
def towns(spark):
    """Every second town, two rows of some, and a null that matches nothing."""
    named = spark.range(0, 4_001, 2).select(F.concat(F.lit("t"), "id").alias("town"), F.col("id").alias("place"))
    more = spark.createDataFrame([("hot", -1), ("hot", -2), ("t0", -3), (None, -4)], "town string, place bigint")
    return named.unionByName(more)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_heavy_hitter_join_equals_the_plain_join(plain_shuffles, orders, towns, how):
    got = heavy_hitter_join(orders, towns, ["town"], spread=["id"], how=how)
    want = orders.join(towns, ["town"], how)
    assert got.columns == want.columns
    assert _rows(got) == _rows(want)


def _largest_to_median(df):
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    sizes += [0] * (PARTS - len(sizes))
    return max(sizes) / max(1, statistics.median(sizes))


def test_a_key_with_a_third_of_the_rows_is_dealt_out(plain_shuffles, orders, towns):
    one_each = towns.groupBy("town").agg(F.min("place").alias("place"))
    assert _largest_to_median(orders.join(one_each, ["town"], "left")) > 4
    assert _largest_to_median(heavy_hitter_join(orders, one_each, ["town"], spread=["id"], how="left")) < 2


def test_only_heavy_keys_are_salted(plain_shuffles, orders, towns):
    hashes = {r.h: r.town for r in orders.select(F.xxhash64("town").alias("h"), "town").distinct().collect()}
    found = {hashes[h]: share for h, share in heavy_keys(orders, ["town"], PARTS)}
    assert set(found) == {"hot", None}
    assert found["hot"] == pytest.approx(1 / 3, rel=0.02)
    even = orders.where("town <> 'hot'")
    plan = heavy_hitter_join(even, towns, ["town"], spread=["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan.lower() and "xxhash64" not in plan


def test_heavy_hitter_join_edge_cases(plain_shuffles, spark, orders, towns):
    none = orders.where("id < 0")
    assert heavy_hitter_join(none, towns, ["town"], spread=["id"]).count() == 0
    assert heavy_hitter_join(orders, towns.where("false"), ["town"], spread=["id"], how="left").count() == 60_000
    # names that the operator would take, and two key columns
    clash = orders.select(F.col("id").alias("_salt0"), "town", F.lit(1).alias("_salts0"), F.lit(2).alias("_key_hash0"))
    twin = towns.withColumn("_salts0", F.lit(1))
    got = heavy_hitter_join(clash, twin, ["town", "_salts0"], spread=["_salt0"])
    assert _rows(got) == _rows(clash.join(twin, ["town", "_salts0"]))
    # equal rows of one key stay together but none is lost
    same = spark.range(1_000).select(F.lit("hot").alias("town"))
    assert heavy_hitter_join(same, towns, ["town"], spread=["town"]).count() == 2_000
    with pytest.raises(ValueError):
        heavy_hitter_join(orders, towns, ["town"], spread=["id"], how="full")
    with pytest.raises(ValueError):
        heavy_hitter_join(orders.withColumn("town", F.col("id")), towns, ["town"], spread=["id"])


def test_distinct_counts_reads_each_row_once_a_column(spark, orders):
    df = orders.withColumn("none", F.lit(None).cast("int"))
    counts = distinct_counts(df)
    assert {r.column: r.distinct for r in counts.collect()} == {
        "id": 60_000, "town": df.agg(F.countDistinct("town")).first()[0], "none": 0}
    assert "Expand" not in counts._jdf.queryExecution().executedPlan().toString()
    assert [r.distinct for r in distinct_counts(df.where("false"), ["id", "town"]).collect()] == [0, 0]
