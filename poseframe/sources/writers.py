"""Sinks: Parquet with nested columns by default, CSV with a header at the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "error") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, decimals: int | None = None, mode: str = "error") -> None:
    """Booleans as 0 and 1, missing values empty; doubles rounded if decimals are given."""
    cols = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f.name)
        cols.append((c.cast("tinyint") if kind == "boolean" else F.round(c, decimals) if kind == "double" and decimals is not None else c).alias(f.name))
    df.select(*cols).write.mode(mode).option("header", True).csv(path)
