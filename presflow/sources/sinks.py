"""Writers: parquet, CSV, JSON, append-only lines, and staged replacement."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import versions


def parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def csv(df: DataFrame, path: str) -> None:
    """One file with a header, for small reports."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def replace(df: DataFrame, path: str) -> None:
    """Writes beside the target, then renames: ``df`` may read from the target, and a failed rename puts the old table back.

    For tables that others read by their path while they are replaced; between the renames there is none, and a crash there leaves the old one under
    its other name: ``restored`` puts it back.  ``versions.commit`` has no such moment.
    """
    spark = df.sparkSession
    staged, old = f"{path}.{uuid4().hex}.new", f"{path}.{uuid4().hex}.old"
    df.write.parquet(staged)
    as_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = as_path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def rename(a: str, b: str) -> None:
        if not fs.rename(as_path(a), as_path(b)):
            raise OSError(f"can't rename {a} to {b}")

    there = fs.exists(as_path(path))
    if there:
        rename(path, old)
    try:
        rename(staged, path)
    except BaseException:
        if there:
            rename(old, path)
        raise
    fs.delete(as_path(old), True)


def restored(spark: SparkSession, path: str) -> bool:
    """Puts the newest table back that a crash in ``replace`` left under its other name; whether there was one."""
    as_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = as_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    left = fs.globStatus(as_path(f"{path}.*.old"))
    newest = max(left, key=lambda f: f.getModificationTime(), default=None)
    return not fs.exists(as_path(path)) and newest is not None and fs.rename(newest.getPath(), as_path(path))


#: Rows that a sheet of a workbook holds.
SHEET_ROWS = 1_000_000


def report(summary: DataFrame, timeline: DataFrame, metadata: DataFrame, path: str) -> str:
    """Three sheets of a workbook, milliseconds as whole numbers.  Returns xlsx, or csv where three CSV folders are written instead: no
    workbook writer is installed, or a table has more rows than a sheet holds.
    """
    sheets = {"Summary": summary, "Timeline": timeline, "Metadata": metadata}
    try:
        import openpyxl  # noqa: F401
        import pandas as pd

        fits = all(df.limit(SHEET_ROWS + 1).count() <= SHEET_ROWS for df in sheets.values())
    except ImportError:
        fits = False
    if not fits:
        for name, df in sheets.items():
            csv(df, f"{path}/{name.lower()}")
        return "csv"
    with pd.ExcelWriter(f"{path}.xlsx", engine="openpyxl") as book:
        for name, df in sheets.items():
            df.toPandas().to_excel(book, sheet_name=name, index=False)
            for i, c in enumerate(df.columns, 1):
                if c.endswith("_ms"):
                    for row in range(2, book.sheets[name].max_row + 1):
                        book.sheets[name].cell(row, i).number_format = "0"
    return "xlsx"


def label_index(vectors: DataFrame, labels: DataFrame, path: str) -> None:
    """Stores an index: vectors (label, embedding) and figures (label, centroid, count, mean_dist, m2), which change together."""
    versions.commit({"vectors": vectors, "labels": labels}, path)


def with_hash(df: DataFrame, *columns: str, length: int = 12) -> DataFrame:
    """``hash``: the first characters of the md5 of the columns joined by ::"""
    return df.withColumn("hash", F.substring(F.md5(F.concat_ws("::", *[F.col(c).cast("string") for c in columns])), 1, length))
