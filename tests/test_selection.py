"""Tiles by rank and bracketed quantiles: small splitter distances and rough
sketches, so that brackets hold many rows and miss the wanted ones at first."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from revlens.operators import quantiles
from revlens.operators.quantiles import exact_quantiles
from revlens.operators.selection import Sort, Tiles, ntile_ends, with_tiles


@pytest.fixture()
def every(spark):
    yield lambda n: spark.conf.set("revlens.select.every", str(n))
    spark.conf.unset("revlens.select.every")


@pytest.mark.parametrize("distance", [1, 3, 50, 5000])
@pytest.mark.parametrize("tasks", [1, 13])
def test_tiles_equal_windows(spark, every, distance, tasks):
    every(distance)
    rng = np.random.default_rng(distance + tasks)
    n = 1500
    value = np.where(rng.random(n) < 0.4, 7, rng.integers(0, 300, n))  # 40 % share a value
    rows = [(f"{i:05d}", None if rng.random() < 0.05 else int(v), float(rng.normal())) for i, v in enumerate(value)]
    df = spark.createDataFrame(rows, "k string, v int, x double").repartition(tasks, "k")
    got = with_tiles(df, [Tiles([Sort("v", desc=True, nulls_first=True)], ["k"], "a", ntile_ends(7)),
                          Tiles(["x"], ["k"], "b", ntile_ends(4))])
    ref = df.select("k", F.ntile(7).over(Window.orderBy(F.col("v").desc_nulls_first(), "k")).alias("a"),
                    F.ntile(4).over(Window.orderBy("x", "k")).alias("b"))
    assert sorted(got.select("k", "a", "b").collect()) == sorted(ref.collect())


def test_tiles_among_some_rows(spark, every):
    every(4)
    df = spark.range(100).withColumn("v", F.col("id") % 5)
    got = {r.id: r.t for r in with_tiles(df, [Tiles(["v"], ["id"], "t")], among=F.col("id") >= 20).collect()}
    order = sorted(range(20, 100), key=lambda i: (i % 5, i))
    assert got == {**{i: None for i in range(20)}, **{i: 1 + place // 20 for place, i in enumerate(order)}}


def test_tiles_of_few_rows_and_none(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    tiles = [Tiles(["v"], ["k"], "t")]
    assert sorted((r.k, r.t) for r in with_tiles(df, tiles).collect()) == [("a", 1), ("b", 2)]
    assert with_tiles(df.where("v > 9"), tiles).collect() == []


def test_descending_text_is_refused(spark):
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    with pytest.raises(TypeError, match="needs a number"):
        with_tiles(df, [Tiles([Sort("k", desc=True)], ["v"], "t")])


def test_tiles_are_lazy(spark, tmp_path):
    """The plan reads its table when the result is read."""
    spark.range(8).write.saveAsTable("tiles_live", path=str(tmp_path / "t"))
    try:
        got = with_tiles(spark.table("tiles_live"), [Tiles(["id"], [], "t")])
        assert got.count() == 8
        spark.range(8, 16).write.insertInto("tiles_live")
        assert {r.id: r.t for r in got.collect()} == {i: 1 + i // 4 for i in range(16)}
    finally:
        spark.sql("DROP TABLE tiles_live")


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_quantiles_equal_numpy(spark, monkeypatch, accuracy):
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    monkeypatch.setattr(quantiles, "_MARGIN", min(0.2, 3 / accuracy))
    rng = np.random.default_rng(accuracy)
    sizes = {"hot": 4000, "tied": 2000, **{f"g{n}": n for n in (1, 2, 3, 4, 5, 6, 7, 10, 11)}}
    rows, ref = [], {}
    for g, n in sizes.items():
        v = np.full(n, 2.5) if g == "tied" else np.round(rng.exponential(10, n), 2)
        v[: n // 3] = v[0]
        ref[g] = v
        rows += [(g, float(x)) for x in v]
    rows += [("null", None), ("hot", None), ("hot", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    qs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {r.g: r for r in exact_quantiles(df, ["v"], qs, groups=["g"]).collect()}
    assert set(got) == {*sizes, "null"}
    for g, v in ref.items():
        assert got[g].v_n == len(v)
        assert [got[g][f"v_q{i}"] for i in range(len(qs))] == pytest.approx(list(np.quantile(v, qs)))
    assert got["null"].v_n == 0 and got["null"].v_q3 is None


def test_quantiles_of_no_rows(spark):
    df = spark.createDataFrame([], "v double")
    row = exact_quantiles(df, ["v"], [0.5], also=[F.max("v").alias("most")]).first()
    assert (row.v_n, row.v_q0, row.most) == (0, None, None)
