"""Bulk ingest of a folder of CSV files.

An entry ``<name>.csv`` of the folder, a file or a directory of part files, is
one table. All files of a table are one scan with its schema; records that do
not fit are kept as text in a column of their own, every row knows its file
(``_metadata.file_path``), and one aggregate over all tables gives the verdict on
each file. The driver sees table names and directory entries, never rows, and
does not loop over files.

A file without records has a verdict of 0 rows. Entries without a known schema
get ``no schema`` and are not scanned. A table that no file belongs to is absent.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.functions.strings import PANDAS_NA, null_tokens
from revlens.sources.csv import MULTILINE_TABLES, table_name

CORRUPT, FILE = "_corrupt_record", "_file"


@dataclass(frozen=True)
class FolderScan:
    """``tables``: name -> rows that fit, with the file of each. ``verdicts``:
    one row for each file (table, file, rows, corrupt_rows, checksum, ok,
    error); ``checksum`` is that of the parsed rows in any order."""
    tables: dict[str, DataFrame]
    verdicts: DataFrame


def _entries(spark: SparkSession, folder: str) -> list[str]:
    """Names of the CSV entries directly in ``folder`` (any Hadoop file system)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(n for n in names if n.endswith(".csv"))


def _file_name(path: Column) -> Column:
    return F.url_decode(F.element_at(F.split(path, "/"), -1))


def _scan(spark: SparkSession, paths: list[str], name: str, schema: T.StructType) -> DataFrame:
    """All rows of a table's files, with the text of those that do not fit."""
    with_corrupt = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    rows = (spark.read.schema(with_corrupt).option("header", True).option("escape", '"')
            .option("multiLine", name in MULTILINE_TABLES).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT)
            .option("columnPruning", False)  # a record fits or not, whatever is read of it
            .csv(paths))
    return rows.select(*rows.columns, F.col("_metadata.file_path").alias(FILE))


def scan_folder(spark: SparkSession, folder: str, schemas: Mapping[str, T.StructType]) -> FolderScan:
    """Scan every CSV entry of ``folder`` whose table is in ``schemas``. Text
    columns have pandas' missing tokens as NULL."""
    of: dict[str, list[str]] = {}
    for entry in _entries(spark, folder):
        of.setdefault(table_name(entry), []).append(f"{folder.rstrip('/')}/{entry}")
    tables, counted, found = {}, None, None
    for name, paths in of.items():
        # names and lengths only; contents are not read
        files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True)
                 .load(paths).select(F.lit(name).alias("table"), F.col("path").alias(FILE),
                                     F.lit(name in schemas).alias("known")))
        found = files if found is None else found.unionByName(files)
        if name not in schemas:
            continue
        rows = _scan(spark, paths, name, schemas[name])
        tables[name] = rows.where(F.col(CORRUPT).isNull()).select(
            *[(null_tokens(f.name, PANDAS_NA) if isinstance(f.dataType, T.StringType) else F.col(f.name)).alias(f.name)
              for f in schemas[name].fields], FILE)
        # Spark refuses a query of nothing but the corrupt column; this is true of every row
        any_row = F.coalesce(F.col(schemas[name].names[0]).cast("string"), F.lit("")) >= ""
        counts = rows.groupBy(FILE).agg(F.count_if(any_row).alias("rows"), F.count(CORRUPT).alias("corrupt_rows"),
                                       F.bit_xor(F.xxhash64(*schemas[name].names)).alias("checksum"))
        counted = counts if counted is None else counted.unionByName(counts)
    kind = "table string, file string, rows long, corrupt_rows long, checksum long, ok boolean, error string"
    if found is None:
        return FolderScan({}, spark.createDataFrame([], kind))
    if counted is None:
        counted = spark.createDataFrame([], f"{FILE} string, rows long, corrupt_rows long, checksum long")

    def plain(path: Column) -> Column:
        # listing and scan write the same path with different slashes
        return F.url_decode(F.regexp_replace(path, "^([a-z0-9]+):/+", "$1:/"))

    counted = counted.select(plain(F.col(FILE)).alias("at"), "rows", "corrupt_rows", "checksum")
    rows, corrupt = F.coalesce("rows", F.lit(0)), F.coalesce("corrupt_rows", F.lit(0))
    verdicts = found.withColumn("at", plain(F.col(FILE))).join(counted, "at", "left").select(
        "table", _file_name(F.col("at")).alias("file"), rows.alias("rows"), corrupt.alias("corrupt_rows"), "checksum",
        (F.col("known") & (corrupt == 0)).alias("ok"),
        F.when(~F.col("known"), "no schema").when(corrupt > 0, F.concat(corrupt.cast("string"), F.lit(" corrupt rows")))
        .alias("error"))
    return FolderScan(tables, verdicts)
