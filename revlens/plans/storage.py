"""Sources and sinks as queries: the adapter's tables leave as CSV or parquet
files in the shared checkpoint folder and come back through the reader or sink
under test; counts and digests of what came back are compared with the tables.
The written files follow the tables in size and are removed with the other
intermediate files (``session.clear_materialized``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.session import scratch_folder
from revlens.sources.csv import read_csv
from revlens.sources.folder import scan_folder
from revlens.sources.sinks import replace_files

Tables = dict[str, DataFrame]

#: Tables that go through files: name in the folder -> name in the table dict.
INGESTED = {"customers": "customers", "orders": "csv_orders", "payments": "payments", "items": "csv_items",
            "products": "products"}


def _text(df: DataFrame, c: str) -> Column:
    """A value as the digest sees it: cents of numbers with a fraction."""
    if isinstance(df.schema[c].dataType, T.DoubleType):
        return F.round(F.col(c) * 100).cast("bigint").cast("string")
    return F.col(c).cast("string")


def _digest(df: DataFrame, columns: list[str]) -> Column:
    """Sum over the rows of 32 bits of an MD5 of their values, whatever the order."""
    row = F.concat_ws("|", *[_text(df, c) for c in columns])
    return F.coalesce(F.sum(F.conv(F.substring(F.md5(row), 1, 8), 16, 10).cast("bigint")), F.lit(0))


def src_05_folder_ingest(t: Tables) -> DataFrame:
    """Write the tables as folders of CSV files, ingest them in bulk, and
    report files in error, rows and digest of each table."""
    spark = t["customers"].sparkSession
    folder = scratch_folder(spark)
    for name, key in INGESTED.items():
        t[key].write.option("header", True).option("escape", '"').csv(f"{folder}/{name}.csv")
    scan = scan_folder(spark, folder, {name: t[key].schema for name, key in INGESTED.items()})
    out = None
    for name, key in INGESTED.items():
        one = scan.tables[name].agg(_digest(t[key], t[key].columns).alias("digest")).select(
            F.lit(name).alias("table"), "digest")
        out = one if out is None else out.unionByName(one)
    verdicts = scan.verdicts.groupBy("table").agg(
        F.sum((~F.col("ok")).cast("bigint")).alias("files_in_error"), F.sum("rows").alias("rows"),
        F.sum("corrupt_rows").alias("corrupt_rows"))
    return verdicts.join(out, "table")


def src_01_inferred_types(t: Tables) -> DataFrame:
    """Write the products as CSV with ``NA`` for missing values, read the file
    without a schema, and report each column's type, missing values and sum in
    hundredths (null for text)."""
    products = t["products"]
    path = scratch_folder(products.sparkSession)
    products.write.option("header", True).option("nullValue", "NA").csv(path)
    df = read_csv(products.sparkSession, path)
    numbers = {f.name for f in df.schema.fields if f.dataType.simpleString() in ("bigint", "double")}
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in df.columns], *[
        F.coalesce(F.sum(F.round(F.col(c) * 100).cast("bigint")), F.lit(0)).alias(f"{c}_sum") for c in numbers])
    rows = [F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"),
                     F.col(f"{f.name}_nulls").alias("nulls"),
                     (F.col(f"{f.name}_sum") if f.name in numbers else F.lit(None).cast("bigint")).alias("hundredths"))
            for f in df.schema.fields]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def snk_01_replace_roundtrip(t: Tables) -> DataFrame:
    """Replace a table of raw orders by the delivered ones, let a failing
    replacement leave them alone, and report what the table holds then."""
    orders = t["csv_orders"]
    path = scratch_folder(orders.sparkSession)
    replace_files(orders, path)
    replace_files(orders.where(F.col("order_status") == "delivered"), path)
    broken = orders.withColumn("order_status", F.when(F.col("order_id") >= 0, F.raise_error(F.lit("refused"))))
    try:
        replace_files(broken, path)
        failed = False
    except Exception as ex:  # noqa: BLE001 - the failure is the case under test
        if "refused" not in str(ex):
            raise
        failed = True
    held = orders.sparkSession.read.parquet(path)
    return held.agg(F.count(F.lit(1)).alias("rows"), _digest(orders, orders.columns).alias("digest"),
                    F.lit(failed).alias("failure_kept_table"))
