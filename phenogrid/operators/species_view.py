"""What the year of a species looks like: evaluated for all species at once.

Input is the species-cell table with rates rounded to four digits. Sums use whole units of 1e-4,
so they do not depend on the order in which partial sums arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from phenogrid.functions import geo, grid, months
from phenogrid.rules import HOME_REGION, HOME_SHARE, MONTHS

UNIT = 10_000


def ranges(labelled: DataFrame) -> DataFrame:
    """(key, cell, lat0, lng0, p, r, u): rounded rates and the same in whole units."""
    counted = labelled.select(
        "key", "cell", grid.whole_lat().alias("lat0"), grid.whole_lng().alias("lng0"),
        "p", months.units("c", "t").alias("u"),
    )
    return counted.withColumn("r", months.from_units("u"))


def peak_rates(ranged: DataFrame) -> DataFrame:
    return ranged.groupBy("key").agg(F.max(F.array_max("r")).alias("peak"))


def cells_per_month(ranged: DataFrame) -> DataFrame:
    return ranged.groupBy("key").agg(months.count_positive("u").alias("cells"))


def first_index(values: Column, wanted: Column) -> Column:
    return (F.array_position(values, wanted) - 1).cast("int")


def year_curve(ranged: DataFrame) -> DataFrame:
    """Presence per month against the peak month, and the first peak and low month (0-based)."""
    sums = ranged.groupBy("key").agg(months.sum_vectors("u").alias("s"))
    scale = f"if(array_max(s) > 0, array_max(s) / {UNIT}, 1D)"
    return sums.select(
        "key", "s", F.expr(f"transform(s, x -> x / {UNIT} / {scale})").alias("presence"),
        first_index(F.col("s"), F.array_max("s")).alias("peak_month"),
        first_index(F.col("s"), F.array_min("s")).alias("low_month"),
    )


def behaviour(ranged: DataFrame) -> DataFrame:
    """Resident everywhere, resident somewhere (mixed), or migratory."""
    resident = F.col("p") == "resident"
    word = F.when(F.bool_and(resident), "resident").when(F.bool_or(resident), "mixed").otherwise("migratory")
    return ranged.groupBy("key").agg(word.alias("behaviour"), F.count("*").alias("total_cells"))


def monthly_centres(ranged: DataFrame, cell_size: float = 1.0) -> DataFrame:
    """Presence-weighted centre on the sphere per species and month with presence."""
    lat, lng = F.col("lat0") + cell_size / 2, F.col("lng0") + cell_size / 2
    x, y, z = geo.unit_vector(lng, lat)
    placed = ranged.select("key", x.alias("x"), y.alias("y"), z.alias("z"), "u")  # before the months are spread
    spread = placed.select("key", "x", "y", "z", months.month_rows("u[i] > 0", month="i", w="u[i]"))
    sums = spread.groupBy("key", "month").agg(F.sum("w").alias("w"), *[F.sum(F.col(a) * F.col("w")).alias(a) for a in "xyz"])
    centre = {a: F.col(a) for a in "xyz"}
    return sums.select(
        "key", "month", "w", geo.lng_of(centre["x"], centre["y"]).alias("lng"), geo.lat_of(centre["x"], centre["y"], centre["z"]).alias("lat")
    )


def latitude_shift(centres: DataFrame) -> DataFrame:
    return centres.groupBy("key").agg((F.max("lat") - F.min("lat")).alias("shift_deg"))


def species_summary(ranged: DataFrame, cell_size: float = 1.0) -> DataFrame:
    shift = latitude_shift(monthly_centres(ranged, cell_size))
    return (
        year_curve(ranged).join(cells_per_month(ranged), "key").join(behaviour(ranged), "key")
        .join(shift, "key", "left").withColumn("shift_deg", F.coalesce("shift_deg", F.lit(0.0)))
    )


def region_months(ranged: DataFrame, home: str, cell_size: float = 1.0) -> DataFrame:
    """Weight and plain weighted centre per species, month and region.

    ``home`` is an SQL test of whether a cell (lat0, lng0) belongs to the home region. The boxes are
    constants, so no box is joined.
    """
    centred = ranged.select("key", "cell", "lat0", "lng0", (F.col("lat0") + cell_size / 2).alias("lat"), (F.col("lng0") + cell_size / 2).alias("lng"), "u")
    located = centred.select("key", "lat", "lng", grid.region_of("lng", "lat", home).alias("region"), "u")
    spread = located.select("key", "lat", "lng", "region", months.month_rows("u[i] > 0", month="i", w="u[i]"))
    sums = spread.groupBy("key", "region", "month").agg(
        F.sum("w").alias("w"), F.sum(F.col("lng") * F.col("w")).alias("x"), F.sum(F.col("lat") * F.col("w")).alias("y")
    )
    return sums.select("key", "region", "month", "w", (F.col("x") / F.col("w")).alias("lng"), (F.col("y") / F.col("w")).alias("lat"))


def region_shares(by_region: DataFrame) -> DataFrame:
    """Share of each region in the month; a month has at most one row per named region."""
    total = F.sum("w").over(Window.partitionBy("key", "month"))
    return by_region.withColumn("total", total).withColumn("share", F.col("w") / F.col("total"))


def dominant_regions(by_region: DataFrame) -> DataFrame:
    """Region with most of the presence per species and month (ties by name), and the home share."""
    best = F.min(F.struct((-F.col("w")).alias("neg"), "region", "lng", "lat")).alias("_b")
    home = F.sum(F.when(F.col("region") == HOME_REGION, F.col("w")).otherwise(0))
    agg = by_region.groupBy("key", "month").agg(best, F.sum("w").alias("total"), home.alias("home"))
    return agg.select(
        "key", "month", F.col("_b.region").alias("region"), (-F.col("_b.neg") / F.col("total")).alias("share"),
        F.col("_b.lng").alias("lng"), F.col("_b.lat").alias("lat"), (F.col("home") / F.col("total")).alias("home_share"),
    )


def journey_legs(dominant: DataFrame) -> DataFrame:
    """Consecutive months in one region as legs, December next to January, in calendar order.

    A species has at most twelve rows here, gathered into one row per species; the legs follow
    from the set of months in which the region changes.
    """
    slots = dominant.groupBy("key").agg(
        F.map_from_entries(F.collect_list(F.struct("month", F.struct("region", "share", "lng", "lat")))).alias("_slots")
    )
    year = slots.select("key", months.each_month("try_element_at(_slots, i)").alias("_y"))
    change = f"_y[i] IS NOT NULL AND NOT (_y[i].region <=> _y[(i + {MONTHS - 1}) % {MONTHS}].region)"
    marked = year.withColumn("_starts", months.months_where(change))
    first = f"coalesce({months.latest_month('_starts')}, 0)"
    rows = marked.select("key", months.month_rows(
        "_y[i] IS NOT NULL", first=first, month="i", region="_y[i].region", share="_y[i].share", lng="_y[i].lng", lat="_y[i].lat"
    ))
    step = F.pmod(F.col("month") - F.col("first"), F.lit(MONTHS))
    legs = rows.groupBy("key", "first").agg(
        F.min_by("region", step).alias("region"), F.max(step).alias("_len"), F.max("share").alias("share"),
        F.min_by("lng", step).alias("lng"), F.min_by("lat", step).alias("lat"),
    ).withColumn("last", F.pmod(F.col("first") + F.col("_len"), F.lit(MONTHS)))
    holds_january = (F.col("first") == 0) | (F.col("first") > F.col("last"))
    w = Window.partitionBy("key").orderBy(holds_january.desc(), "first")
    return legs.withColumn("leg", F.row_number().over(w)).select(
        "key", "leg", F.col("first").alias("from_month"), F.col("last").alias("to_month"), "region", "share", "lng", "lat",
    )


def covers_month(month: int) -> Column:
    """Is the (0-based) month inside the leg; legs may wrap round the year."""
    first, last = F.col("from_month"), F.col("to_month")
    return F.when(first <= last, (F.lit(month) >= first) & (F.lit(month) <= last)).otherwise(
        (F.lit(month) >= first) | (F.lit(month) <= last)
    )


def home_summary(dominant: DataFrame, legs: DataFrame, month: int) -> DataFrame:
    """Months with a fair share in the home region, its first peak month, regions of the year, and
    the region of the leg that covers a month."""
    fair = F.col("home_share") >= HOME_SHARE
    best = F.min(F.when(fair, F.struct((-F.col("home_share")).alias("neg"), "month"))).alias("_b")
    home = dominant.groupBy("key").agg(F.count_if(fair).alias("home_months"), best)
    regions = legs.groupBy("key").agg(
        F.count_distinct("region").alias("regions"), F.max(F.when(covers_month(month), F.col("region"))).alias("region_now")
    )
    return home.join(regions, "key", "left").select(
        "key", "home_months", F.col("_b.month").alias("home_peak"), "regions", "region_now"
    )


def cell_intensity(ranged: DataFrame, t: float) -> DataFrame:
    """Eased rate at a fractional month as a share of the species' peak rate, per cell."""
    peak = F.when(F.col("peak") > 0, F.col("peak")).otherwise(1.0)
    return ranged.join(peak_rates(ranged), "key").select(
        "key", "cell", (months.blend_months("r", t) / peak).alias("intensity")
    )


def mass_at(ranged: DataFrame, t: float) -> DataFrame:
    """Presence of the whole species at a fractional month as a share of its peak month."""
    return year_curve(ranged).select("key", months.blend_months("presence", t).alias("mass"))


def wash_values(ranged: DataFrame, month: int) -> DataFrame:
    """Wash strength per cell with presence in the (0-based) month."""
    value = F.lit(0.2) + F.lit(0.8) * (months.at("r", month) / F.col("peak"))
    return (
        ranged.where(months.at("u", month) > 0).join(peak_rates(ranged), "key")
        .select("key", "cell", "lat0", "lng0", value.alias("value"))
    )


def match_species(index: DataFrame, query: str, limit: int = 6) -> DataFrame:
    """Species whose name matches: prefix, then prefix of a word, then substring; widest first."""
    q = query.strip().lower()
    if not q:
        return index.limit(0).withColumn("rank", F.lit(0))
    name, sci = F.lower("name"), F.lower("sci")
    word = F.exists(F.split(name, r"\s+"), lambda w: w.startswith(q))
    rank = (
        F.when(name.startswith(q) | sci.startswith(q), 0).when(word, 1).when(name.contains(q) | sci.contains(q), 2)
    )
    return (
        index.withColumn("rank", rank).where(F.col("rank").isNotNull())
        .orderBy("rank", F.col("cells").desc(), "k").limit(limit)
    )
