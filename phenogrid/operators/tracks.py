"""Great-circle tracks: length, fraction at each waypoint, position at a fraction.

Waypoints are rows ``(track, seq, lng, lat)`` with dense ``seq`` from 0. Segments come from an equi
join of each waypoint with the next one, and running lengths from chunk totals, so one track that
holds most of the waypoints is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from phenogrid.functions import geo
from phenogrid.rules import EARTH_RADIUS_KM

CHUNK = 4096


def running_sums(rows: DataFrame, key: str, seq: str, value: str, chunk: int = CHUNK) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over earlier rows of the key.

    Rows are summed inside chunks of consecutive ``seq`` and chunks get running offsets, so no task
    holds a whole key; a key's chunk totals are 1/4096 of its rows.
    """
    chunked = rows.withColumn("_chunk", F.floor(F.col(seq) / chunk))
    totals = chunked.groupBy(key, "_chunk").agg(F.sum(value).alias("_t"))
    earlier = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(key, "_chunk", F.coalesce(F.sum("_t").over(earlier), F.lit(0.0)).alias("_o"))
    inside = Window.partitionBy(key, "_chunk").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    summed = chunked.withColumn("_i", F.coalesce(F.sum(value).over(inside), F.lit(0.0)))
    return summed.join(offsets, [key, "_chunk"]).withColumn("before", F.col("_o") + F.col("_i")).drop("_o", "_i", "_chunk")


def segments(waypoints: DataFrame) -> DataFrame:
    """Each waypoint joined to the next one, with the angle between them."""
    following = waypoints.select(
        "track", (F.col("seq") - 1).alias("seq"), F.col("lng").alias("to_lng"), F.col("lat").alias("to_lat")
    )
    return waypoints.join(following, ["track", "seq"]).withColumn(
        "angle", geo.arc(F.col("lng"), F.col("lat"), F.col("to_lng"), F.col("to_lat"))
    )


def track_lengths(waypoints: DataFrame) -> DataFrame:
    return segments(waypoints).groupBy("track").agg(
        (F.sum("angle") * EARTH_RADIUS_KM).alias("km"), (F.count("*") + 1).alias("waypoints")
    )


def waypoint_fractions(waypoints: DataFrame) -> DataFrame:
    """Share of the whole track that lies before each waypoint."""
    parts = segments(waypoints)
    total = parts.groupBy("track").agg(F.sum("angle").alias("total"), F.max("seq").alias("_last"))
    cut = running_sums(parts, "track", "seq", "angle").join(total, "track")
    share = F.when(F.col("total") > 0, F.col("before") / F.col("total")).otherwise(0.0)
    starts = cut.select("track", "seq", share.alias("fraction"))
    ends = total.select("track", (F.col("_last") + 1).alias("seq"), F.when(F.col("total") > 0, 1.0).otherwise(0.0).alias("fraction"))
    return starts.unionByName(ends)


def position_at(waypoints: DataFrame, u: float) -> DataFrame:
    """(lng, lat) at fraction ``u`` of each track: the first segment that reaches it."""
    parts = segments(waypoints)
    total = parts.groupBy("track").agg(F.sum("angle").alias("total"), F.max("seq").alias("last"))
    cut = running_sums(parts, "track", "seq", "angle").join(total, "track")
    wanted = F.col("total") * min(1.0, max(0.0, u))
    rest = wanted - F.col("before")
    reached: Column = (rest <= F.col("angle")) | (F.col("seq") == F.col("last"))
    first = cut.where(reached).withColumn("rest", rest).groupBy("track").agg(
        F.min(F.struct("seq", "lng", "lat", "to_lng", "to_lat", "angle", "rest")).alias("s")
    )
    part = F.when(F.col("s.angle") > 0, F.least(F.col("s.rest") / F.col("s.angle"), F.lit(1.0))).otherwise(0.0)
    lng, lat = geo.along_arc(F.col("s.lng"), F.col("s.lat"), F.col("s.to_lng"), F.col("s.to_lat"), F.col("s.angle"), part)
    return first.select("track", lng.alias("lng"), lat.alias("lat"))
