"""Tables of fixed-length binary records: a file of 32-bit floats, a file of 64-bit ids, a file of column names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _records(spark: SparkSession, path: str, kinds: list[tuple[str, str]], schema: str) -> DataFrame:
    dtype = np.dtype(kinds)
    # Spark splits such files between records; no DataFrame source does.
    placed = spark.sparkContext.binaryRecords(path, dtype.itemsize).zipWithIndex()
    rows = spark.createDataFrame(placed, "record binary, place long")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.frombuffer(b"".join(batch.column("record").to_pylist()), dtype=dtype)
            columns = [pa.array(np.ascontiguousarray(table[name])) for name, _ in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("place"), *columns], names=["place", *(name for name, _ in kinds)])

    return rows.mapInArrow(decoded, f"place long, {schema}")


def binary_table(spark: SparkSession, features: str, names: str, ids: str) -> DataFrame:
    """(oid, one float column for each name): little-endian records, the nth of `features` for the nth of `ids`.

    Names are separated by white space. Where one file has more records than the other, reading fails.
    """
    columns = spark.read.text(names, wholetext=True).first()[0].split()
    values = _records(spark, features, [(c, "<f4") for c in columns], ", ".join(f"`{c}` float" for c in columns))
    oids = _records(spark, ids, [("oid", "<i8")], "oid long").withColumnRenamed("place", "__place")
    both = oids.join(values, F.col("__place") == F.col("place"), "full")
    whole = F.col("__place").isNotNull() & F.col("place").isNotNull()
    oid = F.when(whole, F.col("oid")).otherwise(F.raise_error(F.lit("the files have different numbers of records")).cast("long"))
    return both.select(oid.alias("oid"), *(F.col(f"`{c}`") for c in columns))
