"""Sources, sinks and the streaming rollup."""

import os
import tempfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from revlens.plans.sql_analyses import qry_10_monthly_revenue
from revlens.sources import adapters
from revlens.sources.csv import ingest_folder, read_csv, table_name
from revlens.sources.schemas import RAW_SCHEMAS
from revlens.sources.folder import scan_folder
from revlens.sources.sinks import ingest_to_folder, refresh_rfm_view, register_rfm_view, register_view, replace_files
from revlens.streaming.revenue import (monthly_revenue_stream, read_file_stream,
                                       start_monthly_revenue)

from paths import SF_SMALL


def _folder():
    return tempfile.mkdtemp(prefix="revlens-src-")


def test_read_csv_multiline_and_null_tokens(spark):
    d = _folder()
    p = os.path.join(d, "reviews.csv")
    pd.DataFrame({
        "review_id": ["r1", "r2"], "order_id": ["o1", "o2"], "review_score": [5, 1],
        "review_comment_title": ["null", ""], "review_comment_message": ["line 1\nline 2", "ok"],
        "review_creation_date": ["2018-01-01 00:00:00"] * 2,
        "review_answer_timestamp": ["2018-01-02 00:00:00"] * 2,
    }).to_csv(p, index=False)
    df = read_csv(spark, p, RAW_SCHEMAS["reviews"], na_values=["", "null"], multiline=True)
    rows = {r.review_id: r for r in df.collect()}
    assert rows["r1"].review_comment_message == "line 1\nline 2"
    assert rows["r1"].review_comment_title is None and rows["r2"].review_comment_title is None


def test_ingest_folder_isolates_failures(spark):
    d, out = _folder(), _folder()
    pd.DataFrame({"a": [1, 2]}).to_csv(os.path.join(d, "Good File-1.csv"), index=False)
    pd.DataFrame({"a": [3]}).to_csv(os.path.join(d, "bad.csv"), index=False)
    open(os.path.join(d, "notes.txt"), "w").write("ignored")
    write = ingest_to_folder(out)

    def sink(df, name):
        if name == "bad":
            raise ValueError("refused")
        write(df, name)

    status = {r.table: r for r in ingest_folder(spark, d, sink).collect()}
    assert set(status) == {"good_file_1", "bad"}
    assert status["good_file_1"].ok and not status["bad"].ok
    assert "refused" in status["bad"].error
    assert spark.read.parquet(os.path.join(out, "good_file_1")).count() == 2
    assert table_name("Order Items-2.csv") == "order_items_2"


def test_views(spark, small_tables):
    register_view(small_tables["orders"], "orders_view")
    assert spark.table("orders_view").count() == small_tables["orders"].count()


def test_rfm_view_shows_appended_orders_after_refresh(spark):
    from revlens.plans.sql_analyses import qry_11_rfm_customer_segments
    from revlens.sources.adapters import load_tables
    d = _folder()
    for name in ("orders", "lineitem", "customer", "nation", "part", "supplier", "events"):
        src = spark.read.parquet(f"{SF_SMALL}/{name}.parquet")
        if name == "orders":
            src = src.where("o_orderkey % 2 = 0")
        src.write.parquet(f"{d}/{name}.parquet")
    load = lambda: load_tables(spark, d)
    view = refresh_rfm_view(load)
    assert set(view.columns) == {"customer_unique_id", "customer_segment"}
    before = spark.table("rfm_customer_segments").count()
    (spark.read.parquet(f"{SF_SMALL}/orders.parquet").where("o_orderkey % 2 = 1")
     .write.mode("append").parquet(f"{d}/orders.parquet"))
    assert spark.table("rfm_customer_segments").count() == before  # a snapshot
    refresh_rfm_view(load)
    now = spark.table("rfm_customer_segments")
    assert now.count() > before
    assert sorted(now.collect()) == sorted(qry_11_rfm_customer_segments(load()).collect())


def test_rfm_view_follows_catalog_tables(spark, small_tables):
    from revlens.plans.sql_analyses import qry_11_rfm_customer_segments
    d = _folder()
    names = ("customers", "orders", "payments")
    try:
        for name in names:
            df = small_tables[name].where("order_id % 2 = 0") if name == "orders" else small_tables[name]
            df.write.saveAsTable(f"live_{name}", path=f"{d}/{name}")
        register_rfm_view({name: spark.table(f"live_{name}") for name in names}, "live_rfm")
        before = spark.table("live_rfm").count()
        small_tables["orders"].where("order_id % 2 = 1").write.insertInto("live_orders")
        now = spark.table("live_rfm").collect()
        assert len(now) > before
        assert sorted(now) == sorted(qry_11_rfm_customer_segments(small_tables).collect())
        assert sorted(spark.sql("SELECT * FROM live_rfm").collect()) == sorted(now)
    finally:
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS live_{name}")


def test_scan_folder_verdicts(spark):
    d = _folder()
    os.mkdir(os.path.join(d, "Order Items.csv"))
    good = "a,b\n1,x\n2,NA\n"
    for name, text in (("Order Items.csv/part 1.csv", good), ("Order Items.csv/part-2.csv", "a,b\n3,y\nnot a number,z\n4,w,5\n"),
                       ("Order Items.csv/part-3.csv", "a,b\n"), ("other.csv", good), ("notes.txt", "ignored")):
        with open(os.path.join(d, name), "w") as f:
            f.write(text)
    scan = scan_folder(spark, d, {"order_items": StructType.fromDDL("a int, b string")})
    assert sorted((r.a, r.b) for r in scan.tables["order_items"].collect() if r.b) == [(1, "x"), (3, "y")]
    assert scan.tables["order_items"].where("b is null").select("a").collect() == [(2,)]
    got = {r.file: (r.table, r.rows, r.corrupt_rows, r.ok, r.error) for r in scan.verdicts.collect()}
    assert got == {"part 1.csv": ("order_items", 2, 0, True, None),
                   "part-2.csv": ("order_items", 3, 2, False, "2 corrupt rows"),
                   "part-3.csv": ("order_items", 0, 0, True, None),
                   "other.csv": ("other", 0, 0, False, "no schema")}
    assert scan_folder(spark, _folder(), {}).verdicts.collect() == []


def test_types_are_inferred_after_missing_tokens(spark):
    d = _folder()
    p = os.path.join(d, "t.csv")
    with open(p, "w") as f:
        f.write("i,d,b,s,z,n,big\n1,1.5,True,x,01409,NA,99999999999999999999\nNA,NA,NA,NA,NA,NA,NA\n3,-2e3,false,4,7,NA,1\n")
    df = read_csv(spark, p)
    assert dict(df.dtypes) == {"i": "bigint", "d": "double", "b": "boolean", "s": "string", "z": "bigint",
                               "n": "string", "big": "double"}
    assert [tuple(r) for r in df.select("i", "d", "b", "s", "z").collect()] == [
        (1, 1.5, True, "x", 1409), (None,) * 5, (3, -2000.0, False, "4", 7)]


def test_replace_files_keeps_the_table_if_a_write_fails(spark):
    path = os.path.join(_folder(), "t")
    replace_files(spark.range(3), path)
    broken = spark.range(100).select(F.when(F.col("id") == 77, F.raise_error(F.lit("refused"))).otherwise(F.col("id")).alias("id"))
    for _ in range(2):
        try:
            replace_files(broken, path)
            raise AssertionError("the write did not fail")
        except Exception as ex:  # noqa: BLE001
            assert "refused" in str(ex)
    assert os.listdir(os.path.dirname(path)) == ["t"]
    assert spark.read.parquet(path).count() == 3
    replace_files(spark.read.parquet(path).union(spark.range(2)), path)  # reads what it replaces
    assert spark.read.parquet(path).count() == 5


def test_read_csv_takes_pandas_missing_tokens(spark):
    d = _folder()
    p = os.path.join(d, "t.csv")
    tokens = ["NA", "NaN", "None", "n/a", "null", "", "none", "x", "-"]
    pd.DataFrame({"k": range(len(tokens)), "v": tokens}).to_csv(p, index=False)
    schema = "k int, v string"
    got = [r.v for r in read_csv(spark, p, schema, na_values=["-"]).orderBy("k").collect()]
    ref = pd.read_csv(p, na_values=["-"]).v
    assert got == [None if pd.isna(x) else x for x in ref] == [None] * 6 + ["none", "x", None]
    kept = [r.v for r in read_csv(spark, p, schema, na_values=["-"], keep_default_na=False).orderBy("k").collect()]
    assert kept[:5] == tokens[:5] and kept[8] is None


def test_streaming_monthly_revenue_equals_batch(spark, small_tables):
    li_schema = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").schema
    stream = adapters.payments_from_lineitem(
        read_file_stream(spark, SF_SMALL, li_schema, glob="lineitem.parquet"))
    q = start_monthly_revenue(monthly_revenue_stream(stream, small_tables["orders"]),
                              checkpoint=_folder(), query_name="rev_stream")
    q.awaitTermination(120)
    got = {r.order_month: round(r.monthly_revenue, 2)
           for r in spark.table("rev_stream").collect()}
    ref = {r.order_month: r.monthly_revenue for r in qry_10_monthly_revenue(small_tables).collect()}
    assert got == ref
    q.stop()


def test_foreach_batch_sink(spark, small_tables):
    li_schema = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").schema
    stream = adapters.payments_from_lineitem(
        read_file_stream(spark, SF_SMALL, li_schema, glob="lineitem.parquet"))
    out = _folder()

    def sink(batch, batch_id):
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out)

    q = start_monthly_revenue(monthly_revenue_stream(stream, small_tables["orders"]),
                              checkpoint=_folder(), sink=sink, query_name="rev_sink")
    q.awaitTermination(120)
    assert spark.read.parquet(out).select("order_month").distinct().count() == \
        qry_10_monthly_revenue(small_tables).count()


def test_register_tables_for_sql(spark, small_tables):
    from revlens.sources.sinks import register_tables
    names = register_tables(small_tables, prefix="ec_")
    assert "ec_orders" in names and "ec_payments" in names
    got = spark.sql("""
        SELECT trunc(CAST(o.order_purchase_timestamp AS DATE), 'MM') AS m,
               ROUND(SUM(p.payment_value), 2) AS revenue
        FROM ec_orders o JOIN ec_payments p ON o.order_id = p.order_id
        WHERE o.order_status = 'delivered' GROUP BY 1""").collect()
    ref = {r.order_month.date(): r.monthly_revenue
           for r in qry_10_monthly_revenue(small_tables).collect()}
    assert {r.m: r.revenue for r in got} == ref


def test_cut_lineage_and_cleanup(spark):
    from revlens.session import clear_materialized, cut_lineage
    df = cut_lineage(spark.range(10).withColumn("x", F.col("id") * 2))
    assert df.count() == 10 and df.agg(F.sum("x")).collect()[0][0] == 90
    assert clear_materialized(spark) >= 1
