"""Sinks: replace-table writes (file or catalog), JDBC, and views."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def replace_files(df: DataFrame, path: str, *, fmt: str = "parquet",
                  partition_by: Sequence[str] | None = None) -> None:
    """Replace the table of files at ``path``, all or nothing.

    The new files are staged beside the table, and read back to see that they
    hold as many rows as were written, while the old ones stay as they are. Then the
    old folder is renamed aside, the staged one takes its name, and the old one
    goes. A write that fails leaves the table alone, and so does a swap that
    fails: the old folder gets its name back. ``df`` may read the table that
    it replaces. Renaming a folder is one step on HDFS and local disks; on an
    object store it copies, and readers should go through a catalog.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    fs = target.getFileSystem(conf)
    mark = uuid.uuid4().hex
    staged, aside = (jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{word}-{target.getName()}-{mark}")
                     for word in ("staged", "aside"))
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format(fmt)
    try:
        (out.partitionBy(*partition_by) if partition_by else out).save(staged.toString())
        reader = spark.read.format(fmt)
        held = (reader.schema(df.schema) if fmt in ("csv", "json") else reader).load(staged.toString()).count()
        if held != seen.get["rows"]:
            raise OSError(f"{path}: {seen.get['rows']} rows written, {held} read back")
        fs.mkdirs(target.getParent())
        old = fs.exists(target)
        if old and not fs.rename(target, aside):
            raise OSError(f"{path}: the old table could not be renamed")
        if not fs.rename(staged, target):
            if old:
                fs.rename(aside, target)
            raise OSError(f"{path}: the new table could not be renamed")
        if old:
            fs.delete(aside, True)
    finally:
        if fs.exists(staged):
            fs.delete(staged, True)
    spark.catalog.refreshByPath(path)


def write_table(df: DataFrame, name: str, *, path: str | None = None, fmt: str = "parquet",
                mode: str = "overwrite", partition_by: Sequence[str] | None = None) -> None:
    """Replace a table: files under ``path`` when given, else a catalog table.

    Executors write their partitions in parallel; ``overwrite`` replaces the
    previous content as ``to_sql(if_exists='replace')`` does, for files all or
    nothing (:func:`replace_files`).
    """
    if path and mode == "overwrite":
        replace_files(df, path, fmt=fmt, partition_by=partition_by)
        return
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if path:
        w.save(path)
    else:
        w.saveAsTable(name)


def write_jdbc(df: DataFrame, url: str, table: str, properties: Mapping[str, str],
               mode: str = "overwrite", num_partitions: int | None = None) -> None:
    """Write through JDBC. Credentials come from the caller (``properties``
    with user/password/driver), never from code."""
    out = df.repartition(num_partitions) if num_partitions else df
    out.write.jdbc(url=url, table=table, mode=mode, properties=dict(properties))


def register_view(df: DataFrame, name: str, global_view: bool = False) -> None:
    """``CREATE OR REPLACE VIEW name AS ...``: the plan of ``df`` is run at each
    read, on the files that it listed when it was built."""
    if global_view:
        df.createOrReplaceGlobalTempView(name)
    else:
        df.createOrReplaceTempView(name)


def register_rfm_view(tables: Mapping[str, DataFrame], name: str = "rfm_customer_segments") -> DataFrame:
    """Register the per-person RFM segment view over ``tables``. Its tiles are
    part of the plan, so each read scores the rows that the tables have then:
    rows appended to catalog tables are seen without another call. Tables read
    by path keep the files that they listed; :func:`refresh_rfm_view` lists anew."""
    from revlens.plans.sql_analyses import qry_11_rfm_customer_segments
    df = qry_11_rfm_customer_segments(dict(tables))
    register_view(df, name)
    return df.sparkSession.table(name)


def refresh_rfm_view(load: Callable[[], dict[str, DataFrame]],
                     name: str = "rfm_customer_segments") -> DataFrame:
    """:func:`register_rfm_view` over the tables that ``load`` returns now, for
    tables that are read by path."""
    return register_rfm_view(load(), name)


def ingest_to_folder(root: str, fmt: str = "parquet"):
    """A sink for ``ingest_folder`` writing each table to ``root/<table>``."""
    def sink(df: DataFrame, name: str) -> None:
        write_table(df, name, path=f"{root.rstrip('/')}/{name}", fmt=fmt)
    return sink


def register_tables(tables: dict[str, DataFrame], prefix: str = "") -> list[str]:
    """Register every table of a table dict as a temporary view (names with
    an optional prefix), so analysts can keep querying them with
    ``spark.sql``."""
    names = []
    for name, df in tables.items():
        view = f"{prefix}{name}"
        df.createOrReplaceTempView(view)
        names.append(view)
    return names
