"""Scans of parquet files: places of rows that survive any partitioning, curves with metadata, and observed drops."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from faintlight.curves import canonical, finite
from faintlight.operators.tables import small

#: Names that a column with the object's id may have, in order of preference.
ID_COLUMNS = ("object_id", "source_id", "sourceid", "id")
NO_BANDS, LENGTHS, ERROR_LENGTH, FEW_POINTS = "no bands", "times and magnitudes differ in number", "errors differ in number", "too few finite points"
REASONS = (NO_BANDS, LENGTHS, ERROR_LENGTH, FEW_POINTS)


def positioned(spark, paths: Sequence[str] | str) -> DataFrame:
    """All rows of parquet files with `position`, from 0: paths in the order given, files by name, rows as they stand.

    Each row's place is its file's offset and its index in the file, so it doesn't depend on how the files are split,
    nor on the order in which tasks end. Counting the rows of the files reads their indexes only. A column `position` of
    the files is renamed `input_position`; files of one call may lack columns that others have.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    parts = []
    for i, path in enumerate(paths):
        part = spark.read.parquet(path)
        part = part.withColumnRenamed("position", "input_position")
        parts.append(part.select("*", F.lit(i).alias("__path"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__index")))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    files = rows.groupBy("__path", "__file").agg((F.max("__index") + 1).alias("n"))
    before = Window.orderBy("__path", "__file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    offsets = files.select(F.col("__path").alias("__p"), F.col("__file").alias("__f"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    joined = rows.join(small(offsets), (F.col("__path") == F.col("__p")) & (F.col("__file") == F.col("__f")))
    return joined.withColumn("position", F.col("__offset") + F.col("__index")).drop("__path", "__file", "__index", "__p", "__f", "__offset")


def first_rows(spark: SparkSession, paths: Sequence[str] | str, n: int | None = None) -> DataFrame:
    """The first n rows of files, or all of them, with `position`; unlike limit(), always the same ones."""
    rows = positioned(spark, paths)
    return rows if n is None else rows.where(F.col("position") < n)


def train_and_test(
    spark: SparkSession, train: Sequence[str] | str, test: Sequence[str] | str, max_train: int | None = 25_000, max_test: int | None = 8_000
) -> tuple[DataFrame, DataFrame]:
    """The first rows of the train files, taken one after the other, and those of the test files."""
    return first_rows(spark, train, max_train), first_rows(spark, test, max_test)


def curves_of(rows: DataFrame, bands: Sequence[str] | None = None, class_column: str = "class_str", metadata: Sequence[str] = ("period",)) -> DataFrame:
    """Nested rows as curves: (id_objeto, banda, t, m, e, clase, metadata, src_idx), a row for each band that is there.

    Bands are the fields of `bands_data` (mjd, target, past_feat_dynamic_real). The id is the first of ID_COLUMNS that
    the rows have, else their `position`. Metadata columns that the rows have go into a map from name to number. A row
    without `bands_data` stays, without band, so that it can be counted; bands that are null, or have no times or no
    magnitudes, are left out.
    """
    kind = rows.schema["bands_data"].dataType
    names = list(bands) if bands is not None else kind.fieldNames() if isinstance(kind, StructType) else []
    id_column = next((c for c in ID_COLUMNS if c in rows.columns), "position")
    held = [c for c in metadata if c in rows.columns]
    arrays = "struct<banda:string,t:array<double>,m:array<double>,e:array<double>>"
    each = [
        F.when(
            F.col(f"bands_data.{b}.mjd").isNotNull() & F.col(f"bands_data.{b}.target").isNotNull(),
            F.struct(F.lit(b).alias("banda"), F.col(f"bands_data.{b}.mjd").alias("t"), F.col(f"bands_data.{b}.target").alias("m"), F.col(f"bands_data.{b}.past_feat_dynamic_real").alias("e")),
        ).cast(arrays)
        for b in names
    ]
    there = F.when(F.col("bands_data").isNotNull(), F.filter(F.array(*each), lambda x: x.isNotNull())).otherwise(F.array(F.struct(*(F.lit(None).alias(c) for c in "btme")).cast(arrays)))
    pairs = [x for c in held for x in (F.lit(c), F.col(c).cast("double"))]
    return rows.select(
        F.col(id_column).cast("string").alias("id_objeto"),
        (F.col(class_column).cast("string") if class_column in rows.columns else F.lit(None).cast("string")).alias("clase"),
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")).alias("metadata"),
        F.posexplode(there).alias("src_idx", "curve"),
    ).select("id_objeto", "curve.banda", "curve.t", "curve.m", "curve.e", "clase", "metadata", F.col("src_idx").cast("long").alias("src_idx"))


def reason(least: int = 2) -> Column:
    """Why a curve isn't valid, or null: times and magnitudes, then errors, must be as many; then so many finite points."""
    n = F.size(F.filter(F.arrays_zip(F.col("t").alias("t"), F.col("m").alias("m")), lambda p: finite(p["t"]) & finite(p["m"])))
    return (
        F.when(F.col("t").isNull() | F.col("m").isNull(), NO_BANDS)
        .when(F.size("t") != F.size("m"), LENGTHS)
        .when(F.col("e").isNotNull() & (F.size("e") != F.size("t")), ERROR_LENGTH)
        .when(n < least, FEW_POINTS)
    )


@dataclass
class Scan:
    """Curves that are valid, those that are not with their `reason`, and where asked what an action on the former counts."""

    curves: DataFrame
    rejected: DataFrame
    counts: DataFrame
    observed: Observation | None = None

    def discarded(self) -> dict[str, int]:
        """How many curves each reason took, `curves` and `discarded` in all: as the action on `curves` observed it, which
        must have run, or else by a pass of its own."""
        return dict(self.observed.get) if self.observed else self.counts.first().asDict()


def checked(curves: DataFrame, strict: bool = False, least: int = 2, observe: bool = False) -> Scan:
    """Curves (id_objeto, banda, t, m, e and others) without those that aren't valid.

    With observe=True drops are counted by the action that uses the curves, without a pass of their own. A session that
    has observed can no longer send fitted models of pyspark.ml to tasks (Spark's table of observations isn't
    serializable), so observe curves of a session of their own (spark.newSession()) where models are used too. With
    strict=True the first curve that isn't valid ends the job with its id, band and reason. Null ids and bands are values
    like others.
    """
    seen = Observation() if observe else None
    marked = curves.withColumn("reason", reason(least))
    counts = [F.count("*").alias("curves"), F.count_if(F.col("reason").isNotNull()).alias("discarded"), *(F.count_if(F.col("reason") == r).alias(r) for r in REASONS)]
    watched = marked.observe(seen, *counts) if seen else marked
    if strict:
        told = F.concat_ws(": ", F.concat_ws(" ", F.coalesce("id_objeto", F.lit("no id")), "banda"), "reason")
        kept = watched.where(F.when(F.col("reason").isNull(), True).otherwise(F.raise_error(told).cast("boolean")))
    else:
        kept = watched.where("reason IS NULL")
    return Scan(kept.drop("reason"), marked.where("reason IS NOT NULL"), marked.agg(*counts), seen)


def points(curves: DataFrame) -> DataFrame:
    """The canonical points of curves, with their `metadata`; src_idx is the place within the curve."""
    error = F.coalesce("e", F.transform("t", lambda _: F.lit(None).cast("double")))
    zipped = F.arrays_zip(F.col("t").alias("t"), F.col("m").alias("m"), error.alias("e"))
    each = curves.select("id_objeto", "banda", "clase", "metadata", F.posexplode(zipped).alias("src_idx", "p")).select("id_objeto", "banda", "clase", "src_idx", "metadata", "p.*")
    kinds = canonical(each)
    return each.select(*(F.col(c).cast(k) for c, k in kinds.dtypes), "metadata")


def read_curves(
    spark: SparkSession, paths: Sequence[str] | str, max_objects: int | None = None, strict: bool = False, bands: Sequence[str] | None = None,
    class_column: str = "class_str",
) -> Scan:
    """The valid curves of nested files: the first max_objects rows, or all."""
    return checked(curves_of(first_rows(spark, paths, max_objects), bands, class_column), strict)


def shares(rows: DataFrame, part: Column, label: str) -> DataFrame:
    """(label, n_all, n_part, share_all, share_part): how a class stands in a table and in a part of it."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n_all"), F.count_if(part).alias("n_part"))
    sums = counts.agg(F.sum("n_all").alias("__all"), F.sum("n_part").alias("__part"))
    share = lambda n, whole: F.coalesce(F.try_divide(F.col(n).cast("double"), F.col(whole)), F.lit(0.0))
    return counts.join(F.broadcast(sums)).select(label, "n_all", "n_part", share("n_all", "__all").alias("share_all"), share("n_part", "__part").alias("share_part"))
