"""Sinks: CSV and parquet, with encodings and fixed precision. Spark's writers do the work, one file for each task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fixed(frame: DataFrame, digits: int) -> DataFrame:
    """Doubles and floats as text with so many digits after the point; nulls stay null."""
    shown = lambda c: F.format_string(f"%.{digits}f", F.col(c).cast("double"))
    return frame.withColumns({c: F.when(F.col(c).isNotNull(), shown(c)) for c, kind in frame.dtypes if kind in ("double", "float")})


def to_csv(frame: DataFrame, path: str, mark: bool = False, digits: int | None = None, one_file: bool = False, mode: str = "errorifexists") -> None:
    """Writes a CSV folder with a header in UTF-8. With `mark` the first column's name begins with a byte order mark, as
    spreadsheets expect it; `one_file` is for small results only, which one task then writes."""
    frame = frame if digits is None else fixed(frame, digits)
    if mark and frame.columns:
        frame = frame.withColumnRenamed(frame.columns[0], "﻿" + frame.columns[0])
    frame = frame.coalesce(1) if one_file else frame
    frame.write.mode(mode).option("header", True).option("encoding", "UTF-8").csv(path)


def to_parquet(frame: DataFrame, path: str, by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """Writes a parquet folder, in sub-folders by the columns `by`."""
    frame.write.mode(mode).option("compression", "zstd").partitionBy(*by).parquet(path)
