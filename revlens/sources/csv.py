"""CSV sources: header CSV with a fixed schema, extra NULL tokens, and a
folder ingest that loads every CSV file into a sink with a per-file status.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.functions.strings import PANDAS_NA, null_tokens


# Tables whose quoted text fields may contain line breaks (review comments).
MULTILINE_TABLES = {"reviews"}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             na_values: Sequence[str] | None = None, multiline: bool = False,
             keep_default_na: bool = True) -> DataFrame:
    """Header CSV with double-quote escaping.

    ``multiline=True`` lets quoted fields span lines (review texts do); it
    makes each file a single split, so it is used only where needed and large
    inputs should then arrive as many files. As in pandas, the default missing
    tokens and those of ``na_values`` become NULL; ``keep_default_na=False``
    leaves only the latter. With ``schema`` there is no inference pass, and
    tokens are replaced in text columns. Without, every column is read as text
    and typed by :func:`infer_types` once its tokens are NULL, so that ``1, NA,
    3`` is a column of numbers.
    """
    reader = (spark.read.option("header", True).option("multiLine", multiline)
              .option("escape", '"').option("mode", "PERMISSIVE"))
    df = (reader.schema(schema) if schema is not None else reader).csv(path)
    tokens = (*(PANDAS_NA if keep_default_na else ()), *(na_values or ()))
    df = df.select(*[null_tokens(f.name, tokens).alias(f.name)
                     if tokens and isinstance(f.dataType, T.StringType) else f.name for f in df.schema.fields])
    return df if schema is not None else infer_types(df)


#: Texts that pandas reads as an integer, as a number, and as a truth value.
_INTEGER = r"^\s*[+-]?\d+\s*$"
_NUMBER = r"(?i)^\s*[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?\s*$|^\s*[+-]?inf(inity)?\s*$"
_TRUTH = r"^(True|TRUE|true|False|FALSE|false)$"


def infer_types(df: DataFrame) -> DataFrame:
    """``df`` with its text columns cast to bigint, double or boolean where all
    their values are such; a column without values stays text. One aggregate
    of flags, a row, decides for all columns."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df

    def every(c: str, pattern: str) -> Column:
        return F.coalesce(F.bool_and(F.col(f"`{c}`").rlike(pattern)), F.lit(False))

    flags = df.agg(*[x for i, c in enumerate(texts) for x in (
        (every(c, _INTEGER) & F.coalesce(F.bool_and(F.col(f"`{c}`").try_cast("bigint").isNotNull()
                                                    | F.col(f"`{c}`").isNull()), F.lit(False))).alias(f"i{i}"),
        every(c, _NUMBER).alias(f"n{i}"), every(c, _TRUTH).alias(f"b{i}"))]).first()
    kind = {c: next((t for f, t in (("i", "bigint"), ("n", "double"), ("b", "boolean")) if flags[f"{f}{i}"]), "string")
            for i, c in enumerate(texts)}
    return df.select(*[F.col(f"`{c}`").cast(kind[c]).alias(c) if kind.get(c, "string") != "string" else F.col(f"`{c}`")
                       for c in df.columns])


def table_name(file_name: str) -> str:
    """File name -> table name: drop '.csv', lower case, spaces and '-' -> '_'."""
    return file_name.replace(".csv", "").lower().replace(" ", "_").replace("-", "_")


def list_csv_files(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the ``*.csv`` files directly in ``folder`` (any Hadoop file
    system). Only file names reach the driver; file contents are not read."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.csv")
             .option("recursiveFileLookup", False).load(folder).select("path"))
    return sorted(r.path for r in files.collect())


def ingest_folder(spark: SparkSession, folder: str,
                  sink: Callable[[DataFrame, str], None],
                  schemas: dict[str, T.StructType] | None = None,
                  name_map: Callable[[str], str] | None = None) -> DataFrame:
    """Load every CSV in ``folder`` and hand it to ``sink(df, table_name)``.

    A failure on one file is recorded and the next file is processed. Returns
    a DataFrame (table, file, ok, error). ``schemas`` maps table names (after
    ``name_map``) to fixed schemas; other files are read with inference.
    """
    status = []
    for path in list_csv_files(spark, folder):
        base = os.path.basename(re.sub(r"^file:", "", path))
        name = table_name(base)
        logical = name_map(name) if name_map else name
        try:
            df = read_csv(spark, path, (schemas or {}).get(logical),
                          multiline=logical in MULTILINE_TABLES)
            sink(df, logical)
            status.append((logical, base, True, None))
        except Exception as ex:  # noqa: BLE001 - isolate per-file failures
            status.append((logical, base, False, str(ex).splitlines()[0][:500]))
    return spark.createDataFrame(status, "table string, file string, ok boolean, error string")
