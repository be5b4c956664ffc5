"""Column helpers against Python / pandas semantics."""

import datetime as dt
import unicodedata

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from revlens.functions import bands
from revlens.functions import strings as S
from revlens.functions.dates import (calendar_days, elapsed_hours, floored_days,
                                     fractional_days, minus_months, month_start)
from revlens.functions.maths import cut, haversine_km, haversine_km_radians_first


def _col(spark, values, expr, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"s {typ}")
    return [r[0] for r in df.select(expr(F.col("s"))).collect()]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_categories=["Cs"]),
                        max_size=12), min_size=1, max_size=20))
def test_title_case_equals_python(spark, values):
    assert _col(spark, values, S.title_case) == [v.title() for v in values]


def test_title_case_hazard_h11(spark):
    got = _col(spark, ["vendas@creditparts.com.br", "santa barbara d'oeste", "são paulo"],
               S.title_case)
    assert got == ["Vendas@Creditparts.Com.Br", "Santa Barbara D'Oeste", "SãO Paulo"]
    # initcap differs: only capitalises after spaces
    assert _col(spark, ["vendas@creditparts.com.br"], F.initcap) == ["Vendas@creditparts.com.br"]


def test_py_strip_unicode_whitespace(spark):
    vals = ["  a b \t", " x ", "\n", "", None, "q"]
    assert _col(spark, vals, S.py_strip) == [v.strip() if v is not None else None for v in vals]


def test_zfill_never_shortens_h12(spark):
    vals = ["123", "123456", "", "12345", None]
    assert _col(spark, vals, lambda c: S.zfill(c, 5)) == [
        v.zfill(5) if v is not None else None for v in vals]


def test_clean_zip(spark):
    vals = ["123", "a1-2", "", None, "1234567", "04482"]
    assert _col(spark, vals, S.clean_zip) == ["00123", "00012", None, None, "1234567", "04482"]


def test_nfkd_and_replace(spark):
    vals = ["São Paulo", "Rio", None]
    assert _col(spark, vals, S.nfkd) == [unicodedata.normalize("NFKD", v) if v else v
                                         for v in vals]
    m = {"Rio": "Rio de Janeiro", "X": "Y"}
    assert _col(spark, ["Rio", "Z", None], lambda c: S.replace_values(c, m)) == [
        "Rio de Janeiro", "Z", None]


def test_split_collapse_digits(spark):
    assert _col(spark, ["sao paulo/sp", "a-b", "c"], lambda c: S.before_first(c, "/")) == [
        "sao paulo", "a-b", "c"]
    assert _col(spark, ["a  \t b"], S.collapse_ws) == ["a b"]
    assert _col(spark, ["04482255", "12a", ""], S.is_digits) == [True, False, False]


def _ts(spark, pairs):
    return spark.createDataFrame(pairs, "a timestamp_ntz, b timestamp_ntz")


def test_day_differences(spark):
    a = dt.datetime(2018, 1, 10, 12)
    rows = [(a, dt.datetime(2018, 1, 10, 0)), (a, dt.datetime(2018, 1, 11, 0)),
            (a, dt.datetime(2018, 1, 8, 23)), (None, a)]
    df = _ts(spark, rows)
    got = df.select(fractional_days("a", "b"), floored_days("a", "b"), calendar_days("a", "b"),
                    elapsed_hours("a", "b")).collect()
    pa = pd.DataFrame(rows, columns=["a", "b"])
    delta = pa["a"] - pa["b"]
    assert [r[1] for r in got] == [None if pd.isna(x) else int(x) for x in delta.dt.days]
    assert [r[0] for r in got][:3] == pytest.approx([0.5, -0.5, 1 + 13 / 24])
    assert [r[2] for r in got] == [0, -1, 2, None]
    assert [r[3] for r in got][:3] == pytest.approx([12.0, -12.0, 37.0])


def test_month_arithmetic(spark):
    df = _ts(spark, [(dt.datetime(2018, 8, 31, 10), None)])
    r = df.select(minus_months("a", 6).alias("m"), month_start("a").alias("s")).collect()[0]
    assert r.m == dt.datetime(2018, 2, 28, 10)  # end-of-month clamp
    assert r.s == dt.datetime(2018, 8, 1)


def test_bins_h3(spark):
    vals = [0.0, 50.0, 100.0, 300.0, 500.0, 501.0, None]
    sql = _col(spark, vals, bands.distance_band, "double")
    assert sql == ["Local", "Local", "Regional", "Regional", "Regional", "Long Distance",
                   "Long Distance"]
    nb = _col(spark, vals, bands.distance_bin, "double")
    ref = pd.cut(pd.Series(vals, dtype=float), [0, 100, 500, float("inf")],
                 labels=list(bands.DIST_BIN_LABELS))
    assert nb == [None if pd.isna(x) else x for x in ref]
    aov = _col(spark, [99.99, 100.0, 300.0, 300.01], bands.aov_segment, "double")
    assert aov == [bands.AOV_LOW, bands.AOV_MEDIUM, bands.AOV_MEDIUM, bands.AOV_HIGH]
    inst = _col(spark, [1, 2, 6, 7, 0], bands.installment_group, "int")
    assert inst == [bands.INST_SINGLE, bands.INST_2_6, bands.INST_2_6, bands.INST_7_PLUS,
                    bands.INST_7_PLUS]
    rating = _col(spark, [1.5, 2.0, 3.0, 4.0, 5.0], bands.rating_band, "double")
    assert rating == [bands.RATING_POOR, bands.RATING_BELOW, bands.RATING_GOOD,
                      bands.RATING_EXCELLENT, bands.RATING_EXCELLENT]
    got = _col(spark, [0, 1, 6, 7, 101], lambda c: cut(c, [0, 1, 6, 100],
                                                                ["Single", "2-6", "7+"]), "int")
    assert got == [None, "Single", "2-6", "7+", None]


def test_haversine(spark):
    df = spark.createDataFrame([(-23.5, -46.6, -22.9, -43.2), (-10.0, -50.0, -10.0, -50.0),
                                (0.0, 0.0, 0.0, 180.0)], "a double, b double, c double, d double")
    r = df.select(haversine_km("a", "b", "c", "d").alias("x"),
                  haversine_km_radians_first("c", "d", "a", "b").alias("y")).collect()
    assert r[0].x == pytest.approx(r[0].y)  # symmetric
    assert 340 < r[0].x < 370
    assert r[1].x == 0.0
    assert r[2].x == pytest.approx(3.141592653589793 * 6371.0)  # half circumference


def test_elapsed_time_ignores_session_time_zone(spark):
    # 2018-11-04 00:00 is a daylight-saving jump in America/Sao_Paulo
    rows = [(dt.datetime(2018, 11, 5, 0, 0), dt.datetime(2018, 11, 3, 12, 0, 0, 250))]
    df = _ts(spark, rows)
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
        r = df.select(floored_days("a", "b").alias("d"), elapsed_hours("a", "b").alias("h")).collect()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert r.d == 1
    assert r.h == pytest.approx(36 - 250 / 3.6e9)


def test_h2_h6_h8_order_rounding_division(spark):
    from revlens.functions.maths import pct, safe_ratio
    from revlens.operators.ordering import Sort
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, 7.0)], "k int, v double")
    # H2: PostgreSQL DESC puts NULLs first; Spark's default DESC puts them last
    got = [r.k for r in df.orderBy(Sort("v", desc=True, nulls_first=True).spark_order()).collect()]
    assert got == [1, 3, 2]
    # H6: SQL rounding is half-up, numpy display rounding half-to-even
    r = spark.range(1).select(F.round(F.lit(0.125), 2).alias("up"),
                              F.bround(F.lit(0.125), 2).alias("even")).collect()[0]
    assert (r.up, r.even) == (0.13, 0.12)
    # H8: ratios never raise on a zero denominator under ANSI
    r = spark.range(1).select(safe_ratio(F.lit(1), F.lit(0)).alias("a"),
                              pct(F.lit(3), F.lit(4)).alias("b")).collect()[0]
    assert r.a is None and r.b == 75.0
