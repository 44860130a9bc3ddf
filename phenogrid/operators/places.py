"""Place names: parsing, the major list, chunks by tile, and label eligibility."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from phenogrid.functions import tiles
from phenogrid.rules import CAPITAL_SCALE, LABEL_FLOORS, MAJOR_POPULATION, PLACE_CHUNK_LEVEL, PLACE_KINDS, SEAT_SCALE


def place_kind(code: Column) -> Column:
    """0 national capital, 1 first-order seat, 2 any other populated place."""
    chain = F.lit(2)
    for known, kind in PLACE_KINDS.items():
        chain = F.when(code == known, F.lit(kind)).otherwise(chain)
    return chain


def parsed_places(lines: DataFrame) -> DataFrame:
    """Fields of 19-column tab-separated lines (column ``value``) with a ``valid`` flag.

    A line is malformed when it is short, a number does not parse, the coordinate is off the globe
    or the name is empty; blank lines are neither valid nor malformed.
    """
    f = F.split("value", "\t", -1)
    population = F.when(F.get(f, F.lit(14)) == "", F.lit("0")).otherwise(F.get(f, F.lit(14)))
    fields = lines.select(
        (F.size(f) >= 19).alias("_long"), (F.trim("value") != "").alias("_text"), F.get(f, F.lit(1)).alias("name"),
        F.get(f, F.lit(5)).try_cast("double").alias("lng"), F.get(f, F.lit(4)).try_cast("double").alias("lat"),
        population.try_cast("long").alias("population"), place_kind(F.get(f, F.lit(7))).alias("kind"),
        F.get(f, F.lit(8)).alias("country"), F.get(f, F.lit(10)).alias("admin_code"),
    )
    good = (
        F.col("_long") & F.col("population").isNotNull() & F.col("lat").between(-90, 90)
        & F.col("lng").between(-180, 180) & (F.col("name") != "")
    )
    return fields.withColumn("valid", F.coalesce(good, F.lit(False))).withColumn("malformed", F.col("_text") & ~F.col("valid")).drop("_long", "_text")


def valid_places(parsed: DataFrame) -> DataFrame:
    return parsed.where("valid").drop("valid", "malformed")


def parse_report(parsed: DataFrame) -> DataFrame:
    return parsed.agg(F.count_if("valid").alias("places"), F.count_if("malformed").alias("malformed"))


def with_admin(places: DataFrame, admin: DataFrame) -> DataFrame:
    """Adds the first-order division's name by ``country.code`` (the table's size is left to Spark)."""
    named = admin.select(F.col("code").alias("_code"), F.col("name").alias("admin1"))
    coded = places.withColumn("_code", F.concat_ws(".", "country", "admin_code"))
    return coded.join(named, "_code", "left").drop("_code").withColumn("admin1", F.coalesce("admin1", F.lit("")))


def with_major(places: DataFrame) -> DataFrame:
    return places.withColumn("major", (F.col("population") >= MAJOR_POPULATION) | (F.col("kind") == 0))


def with_chunk(places: DataFrame, level: int = PLACE_CHUNK_LEVEL) -> DataFrame:
    """Tile a place is stored under, ``major`` for the list that is loaded first."""
    x, y = tiles.tile_x(F.col("lng"), level), tiles.tile_y(F.col("lat"), level)
    chunk = F.when(F.col("major"), F.lit("major")).otherwise(F.concat_ws("_", x.cast("string"), y.cast("string")))
    return places.withColumn("chunk", chunk)


def ranked_by_population(chunked: DataFrame) -> DataFrame:
    """Position of each place in its list, by population and name.

    The major list may hold most of the places, so positions are not numbered in one task per list:
    places are numbered inside bands of equal magnitude of the population, and the bands, a few
    hundred per list, get running offsets.
    """
    band = F.floor(F.log2(F.greatest(F.col("population"), F.lit(1)) + 1.0) * 16).cast("int")
    banded = chunked.withColumn("_band", band)
    sizes = banded.groupBy("chunk", "_band").agg(F.count("*").alias("_n"))
    above = Window.partitionBy("chunk").orderBy(F.col("_band").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("chunk", "_band", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_o"))
    inside = F.row_number().over(Window.partitionBy("chunk", "_band").orderBy(F.col("population").desc(), "name"))
    return banded.withColumn("_i", inside).join(offsets, ["chunk", "_band"]).withColumn(
        "pos", (F.col("_o") + F.col("_i")).cast("int")
    ).drop("_band", "_i", "_o")


def place_manifest(chunked: DataFrame, report: DataFrame | None = None) -> DataFrame:
    """Counts of the product, and of the lines that were no places if the parse report is given."""
    counts = chunked.agg(
        F.count_if("major").alias("major"), F.count_if(~F.col("major")).alias("chunked"),
        F.count_distinct(F.when(~F.col("major"), F.col("chunk"))).alias("chunks"),
    )
    if report is None:
        return counts
    one = F.lit(1).alias("_one")  # one row each
    return counts.select("*", one).join(report.select("malformed", one), "_one").drop("_one")


def population_floor(altitude_km: float) -> float:
    """Smallest population shown at an altitude, log-interpolated between the table's rows."""
    if altitude_km >= LABEL_FLOORS[0][0]:
        return float(LABEL_FLOORS[0][1])
    for (upper, upper_pop), (lower, lower_pop) in zip(LABEL_FLOORS, LABEL_FLOORS[1:], strict=False):
        if altitude_km >= lower:
            part = math.log(altitude_km / lower) / math.log(upper / lower)
            return math.exp(math.log(lower_pop) + (math.log(upper_pop) - math.log(lower_pop)) * part)
    return float(LABEL_FLOORS[-1][1])


def label_candidates(places: DataFrame, altitude_km: float) -> DataFrame:
    """Places that may show at the altitude, with their priority and text size."""
    floor = population_floor(altitude_km)
    scale = F.when(F.col("kind") == 0, CAPITAL_SCALE).when(F.col("kind") == 1, SEAT_SCALE).otherwise(1.0)
    bonus = F.when(F.col("kind") == 0, 1.2).when(F.col("kind") == 1, 0.4).otherwise(0.0)
    ratio = F.col("population") / floor
    size = F.when((ratio > 20) | (F.col("kind") == 0), "l").when(ratio > 4, "m").otherwise("s")
    return places.where(F.col("population") >= F.lit(floor) * scale).withColumns({
        "priority": F.log10(F.greatest(F.col("population"), F.lit(1))) + bonus, "size": size,
    })


def top_labels(places: DataFrame, altitude_km: float, limit: int) -> DataFrame:
    """The ``limit`` places of highest priority (a distributed top-k, no full sort)."""
    return label_candidates(places, altitude_km).orderBy(F.col("priority").desc(), "name", "lng", "lat").limit(limit)


def short_name(fields: list[Column], state: Column, country: Column) -> tuple[Column, Column]:
    """Name and context of an address: the first non-empty field, and state and country without it."""
    name = F.coalesce(*[F.nullif(f, F.lit("")) for f in fields], F.nullif(state, F.lit("")))
    context = F.filter(F.array(state, country), lambda part: part.isNotNull() & (part != "") & (part != name))
    return name, F.array_join(context, ", ")
