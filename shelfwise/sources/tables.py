"""CSV, Parquet and JSON tables, raw and clean versions, previews, audit trail."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.text import name_col, round2

PREVIEW_ROWS = 25


def read_csv(spark: SparkSession, path: str, typed: bool = False, multi_line: bool = True) -> DataFrame:
    """A CSV with a header. Everything is read as text, so no dirt is lost;
    ``typed`` infers types with an extra pass over the file.

    ``multi_line`` reads line breaks inside quotes; then a file is read by one
    task. Turn it off for large files known to hold none, which are then split.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    return reader.option("inferSchema", typed).csv(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    if path.rstrip("/").endswith(".csv"):
        return read_csv(spark, path)
    return spark.read.parquet(path)


def read_tables(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, DataFrame]:
    """Named tables; a path that is missing is skipped."""
    tables = {}
    for name, path in paths.items():
        try:
            tables[name] = read_table(spark, path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return tables


def read_folder(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """One table per CSV of a folder, named after the file; a file that cannot
    be read is skipped. The listing works on any Hadoop file system."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    tables = {}
    for status in files.listStatus(hadoop_path):
        name = status.getPath().getName()
        if name.endswith(".csv"):
            try:
                tables[name[: -len(".csv")]] = read_csv(spark, status.getPath().toString())
            except AnalysisException:
                continue
    return tables


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_metadata(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def register_versions(name: str, raw: DataFrame, clean: DataFrame | None = None) -> None:
    """Temporary views <name>_raw and <name>_clean."""
    raw.createOrReplaceTempView(f"{name}_raw")
    if clean is not None:
        clean.createOrReplaceTempView(f"{name}_clean")


def catalog(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(name, rows, columns, is_clean, is_raw), one row per table."""

    def entry(name, df):
        return df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("name"),
            "rows",
            F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
            F.lit(name.endswith("_clean")).alias("is_clean"),
            F.lit(name.endswith("_raw")).alias("is_raw"),
        )

    return reduce(DataFrame.unionByName, [entry(n, d) for n, d in tables.items()])


def presentable(df: DataFrame, column: str) -> Column:
    """Floats at two decimals with NaN as null, numbers, booleans and text as
    they are, anything else as text."""
    kind = df.schema[column].dataType
    c = name_col(column)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        shown = round2(F.nanvl(c.cast("double"), F.lit(None))).cast("double")
    elif isinstance(kind, T.DecimalType):
        shown = F.round(c, 2)
    elif isinstance(kind, (T.IntegralType, T.BooleanType, T.StringType)):
        shown = c
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        shown = F.to_json(c)
    else:
        shown = c.cast("string")
    return shown.alias(column)


def preview(df: DataFrame, order_by: Sequence[Column | str], limit: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows of a total order, ready to be shown."""
    head = df.orderBy(*order_by).limit(limit)
    return head.select(*[presentable(df, c) for c in df.columns])


def append_audit(evidence: DataFrame, path: str, session_id: str, turn: int) -> None:
    """Add one answered query to the audit table, keyed by session and turn.

    An append replaces its own key's files and touches no others, so one that is
    tried again leaves one row. A history reads its own session's folders only.
    """
    tagged = evidence.withColumns({"session_id": F.lit(session_id), "turn": F.lit(turn)})
    keyed = tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    keyed.partitionBy("session_id", "turn").parquet(path)


def session_history(spark: SparkSession, path: str, session_id: str) -> DataFrame:
    table = spark.read.parquet(path)
    return table.where(F.col("session_id") == session_id).orderBy("turn")
