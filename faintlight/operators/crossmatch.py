"""Positions from designations and cone joins with catalogues."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faintlight.operators.tables import set_checkpoints

#: Catalogue positions in the densest cell of the first search, about, and how often the radius is halved for that at most.
CELL = 32
HALVINGS = 30

_NAME = r"^CSS_J(\d{2})(\d{2})(\d{2}(?:\.\d+)?)([+-])(\d{2})(\d{2})(\d{2}(?:\.\d+)?)"


def position(designation: Column) -> tuple[Column, Column]:
    """Right ascension and declination in degrees from names that begin with CSS_Jhhmmss.s+ddmmss; null for others."""
    part = lambda i: F.regexp_extract(designation, _NAME, i).try_cast("double")
    sign = F.when(F.regexp_extract(designation, _NAME, 4) == "-", -1.0).otherwise(1.0)
    return (part(1) + part(2) / 60 + part(3) / 3600) * 15, sign * (part(5) + part(6) / 60 + part(7) / 3600)


def separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Angle in degrees (haversine)."""
    a, b, d = F.radians(dec1), F.radians(dec2), F.radians(ra1 - ra2)
    h = F.sin((a - b) / 2) ** 2 + F.cos(a) * F.cos(b) * F.sin(d / 2) ** 2
    return F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


def _ring(dec: Column, size: float) -> Column:
    return F.floor((dec + 90) / size)


def _cells(ring: Column, size: float) -> Column:
    """How many steps of right ascension a ring of declinations has."""
    # The largest declination that a match from this ring can have bounds how far apart right ascensions may be.
    top = F.greatest(F.abs(ring * size - 90), F.abs((ring + 1) * size - 90)) + size
    return F.when(top >= 90 - size, 1).otherwise(F.greatest(F.floor(360 * F.cos(F.radians(top)) / (1.1 * size)), F.lit(1)))


def _cell(ra: Column, ring: Column, size: float) -> Column:
    return F.least(F.floor(F.pmod(ra, F.lit(360.0)) / 360 * _cells(ring, size)), _cells(ring, size) - 1)


def _in_cells(stars: DataFrame, size: float) -> DataFrame:
    return stars.withColumn("ring", _ring(F.col("cat_dec"), size)).withColumn("cell", _cell(F.col("cat_ra"), F.col("ring"), size))


def first_radius(stars: DataFrame, radius: float) -> float:
    """A radius, at most the given one, at which no cell has more than about CELL positions (HALVINGS halvings at most)."""
    least = radius / 2**HALVINGS
    while radius > least:
        densest = _in_cells(stars, radius).groupBy("ring", "cell").count().agg(F.max("count")).first()[0] or 0
        if densest <= CELL:
            break
        radius = max(least, radius / 2 ** math.ceil(math.log(densest / CELL, 4)))
    return radius


def candidates(positions: DataFrame, stars: DataFrame, radius: float) -> DataFrame:
    """All pairs of positions (ra, dec, different) and stars (cat_id, cat_ra, cat_dec) of their own and neighbouring cells:
    every pair within the radius is one of them."""
    size = radius * (1 + 1e-6)  # what rounding does to a declination crosses no second ring
    near = positions.withColumn("ring", F.explode(F.array(*(_ring(F.col("dec"), size) + i for i in (-1, 0, 1)))))
    own, cells = _cell(F.col("ra"), F.col("ring"), size), _cells(F.col("ring"), size)
    near = near.withColumn("cell", F.explode(F.array_distinct(F.array(*(F.pmod(own + i, cells) for i in (-1, 0, 1))))))
    pairs = near.join(_in_cells(stars, size), ["ring", "cell"])
    return pairs.withColumn("distance", separation(F.col("ra"), F.col("dec"), F.col("cat_ra"), F.col("cat_dec")))


def cone_join(objects: DataFrame, catalogue: DataFrame, radius: float = 5 / 3600) -> DataFrame:
    """Each object with its nearest catalogue row within the radius (degrees), or nulls; ties by smaller cat_id.

    Both have ra and dec; objects have id, the catalogue cat_id. Positions are copied to the neighbouring cells of a grid
    of declination rings and right-ascension steps, so that the join is one on equal cells. As only the nearest row is
    asked for, cones begin so narrow that no cell is crowded, and twice as wide ones are searched for those positions
    alone that have found nothing. Of rows at one position only that with the smallest cat_id can be found, and objects
    at one position are searched once.
    """
    set_checkpoints(objects.sparkSession)
    stars = catalogue.where("ra IS NOT NULL AND dec IS NOT NULL").groupBy(F.col("ra").alias("cat_ra"), F.col("dec").alias("cat_dec")).agg(F.min("cat_id").alias("cat_id")).checkpoint()
    left = objects.select("ra", "dec").where("ra IS NOT NULL AND dec IS NOT NULL").distinct().checkpoint()
    reach, found = first_radius(stars, radius), []
    while True:
        near = candidates(left, stars, reach).where(F.col("distance") <= reach)
        found.append(near.groupBy("ra", "dec").agg(F.min(F.struct("distance", "cat_id")).alias("x")).checkpoint())
        if reach >= radius:
            break
        left = left.join(found[-1].select("ra", "dec"), ["ra", "dec"], "left_anti").checkpoint()
        if left.isEmpty():
            break
        reach = min(2 * reach, radius)
    best = reduce(DataFrame.unionByName, found).select("ra", "dec", "x.cat_id", "x.distance")
    return objects.select("id", "ra", "dec").join(best, ["ra", "dec"], "left").select("id", "cat_id", "distance")
