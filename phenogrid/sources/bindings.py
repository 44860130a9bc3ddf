"""The engine's inputs derived from the star-schema test tables.

Every frame here is a plain projection or join of the given tables, so its size follows theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phenogrid.operators import counting, naming, presence

# The binding's own sensitive and featured lists.
SENSITIVE = ("Species 3", "Species 12")
FEATURED = ("Species 1", "Species 2", "Species 5", "Species 41", "Species 43")

# Pixel grid: level 15 with tiles of 8 px, the parts placed along a Morton curve from an origin
# at the prime meridian and 67.5 degrees north.
LEVEL = 15
TILE_PX = 8
GX0 = 1 << 18
GY0 = 1 << 15
MORTON_BITS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_lat(key: Column) -> Column:
    return ((key * 7919) % 18000).cast("double") / 100.0 - 90


def spread_lng(key: Column) -> Column:
    return ((key * 104729) % 36000).cast("double") / 100.0 - 180


LAT = "cast(({key} * 7919) % 18000 AS double) / 100D - 90"
LNG = "cast(({key} * 104729) % 36000 AS double) / 100D - 180"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One occurrence record per line item, with the fields the quality filter reads."""
    line = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_discount", "l_tax",
        "cast(l_partkey % 40 AS int) AS sp", "month(l_shipdate) AS month", "year(l_shipdate) AS year",
    )
    kept = line.where("(month + sp * 5) % 12 < CASE sp % 4 WHEN 1 THEN 6 WHEN 2 THEN 2 ELSE 12 END")
    return kept.selectExpr(
        "l_orderkey", "l_linenumber", "sp", "month", "year",
        LAT.format(key="l_suppkey") + " AS lat", LNG.format(key="l_suppkey") + " AS lng",
        "CASE WHEN sp % 10 <> 9 THEN concat('Species ', sp) END AS sci",
        "CASE WHEN sp % 10 <> 9 THEN concat('Q', sp) END AS specieskey",
        "CASE WHEN sp % 10 <> 9 THEN concat('Family ', sp % 6) END AS family",
        "CASE WHEN l_linenumber = 7 THEN 'Mammalia' ELSE 'Aves' END AS class",
        "CASE WHEN l_returnflag = 'R' THEN 'ABSENT' ELSE 'PRESENT' END AS status",
        "l_discount < 0.1D AS has_coordinate", "l_tax > 0.07D AS has_issue", "cast(l_suppkey % 25 AS int) AS nation",
    )


def month_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all records, before masking."""
    return counting.count_records(records(spark, sf_dir))


def masked_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.mask_sensitive(month_counts(spark, sf_dir), SENSITIVE)


def pairs_and_effort(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Masked species-cell vectors and effort of all records, from one scan."""
    hidden = F.coalesce(F.col("sci").isin(*SENSITIVE), F.lit(False))
    masked = records(spark, sf_dir).withColumn("sci", F.when(~hidden, F.col("sci")))
    return counting.split_grid(counting.month_grid(masked))


def labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(species-cells by key with vectors, month set and label, effort)."""
    pairs, effort = pairs_and_effort(spark, sf_dir)
    keyed = counting.merge_pairs(naming.with_keys(pairs, names(spark, sf_dir)), "key", "cell")
    return presence.label_presence(keyed, effort), effort


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names dimension from the parts: some species missing, two sharing a key."""
    species = table(spark, sf_dir, "part").selectExpr("cast(p_partkey % 40 AS int) AS sp").distinct()
    return species.where("sp % 7 <> 0 AND sp % 10 <> 9").selectExpr(
        "concat('Species ', sp) AS sci", "cast(if(sp = 8, 1004, sp + 1000) AS string) AS key",
        "if(sp % 5 <> 0, concat('Bird ', sp), '') AS common", "if(sp % 3 <> 0, concat('Family ', sp % 6), '') AS family",
    )


def sensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensitive species found among the parts, as a table."""
    sp = F.concat(F.lit("Species "), (F.col("p_partkey") % 40).cast("string")).alias("sci")
    return table(spark, sf_dir, "part").select(sp).where(F.col("sci").isin(*SENSITIVE)).distinct()


def morton(key: str, offset: int) -> Column:
    """Every second bit of the key from ``offset`` on, packed together by halving the gaps."""
    start = f"shiftright({key}, {offset}) & {0x5555555555555555}L"
    steps = ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, (1 << MORTON_BITS) - 1))
    listed = ", ".join(f"named_struct('by', {by}, 'keep', {keep}L)" for by, keep in steps)
    return F.expr(f"cast(aggregate(array({listed}), {start}, (x, s) -> (x | shiftright(x, s.by)) & s.keep) AS int)")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel table from the parts: class, tree cover (NULL where missing) and elevation."""
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey", (morton("p_partkey", 0) + GX0).alias("gx"), (morton("p_partkey", 1) + GY0).alias("gy"),
        (F.col("p_size") % 12).alias("cls"),
        F.when(F.col("p_size") % 10 != 0, F.col("p_retailprice") % 100).alias("tree"), F.col("p_retailprice").alias("elev"),
    )


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene values per pixel and day: one per line item."""
    line = table(spark, sf_dir, "lineitem")
    scl = F.when(F.col("l_returnflag") == "A", 4).when(F.col("l_returnflag") == "N", 8).otherwise(11)
    return line.select(
        F.col("l_partkey").alias("pixel"), F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("value"), scl.alias("scl"),
        (F.col("l_linenumber") * 8).alias("cloud"),
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Populated places from the customers, with the nation's name as country."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").join(nation, "c_nationkey").select(
        F.col("c_name").alias("name"), spread_lng(key * 31 + 7).alias("lng"), spread_lat(key * 17 + 3).alias("lat"),
        F.floor(F.abs("c_acctbal") * 100).cast("long").alias("population"),
        F.when(key % 50 == 0, "PPLC").when(key % 10 == 1, "PPLA").when(key % 10 == 2, "PPLG").otherwise("PPL").alias("code"),
        F.col("n_name").alias("country"), F.col("c_mktsegment").alias("admin_code"),
    )


def waypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks from the orders: 100 tracks with dense sequence numbers."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        (key % 100).alias("track"), F.floor(key / 100).cast("long").alias("seq"),
        spread_lng(key * 13 + 1).alias("lng"), spread_lat(key * 7 + 5).alias("lat"),
    )


def taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent tree over the parts: the parent of k is k div 2, the rank follows the size."""
    p = table(spark, sf_dir, "part")
    rank = (
        F.when(F.col("p_size") % 5 == 1, "genus").when(F.col("p_size") % 5 == 2, "family")
        .when(F.col("p_size") % 5 == 3, "order").when(F.col("p_size") % 25 == 4, "class")
    )
    return p.select(
        F.col("p_partkey").alias("node"), F.floor(F.col("p_partkey") / 2).cast("long").alias("parent"), rank.alias("rank"),
        F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("name"),
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims about items: one per line item, ranked by its tax."""
    line = table(spark, sf_dir, "lineitem")
    rank = F.when(F.col("l_tax") > 0.06, "preferred").when(F.col("l_tax") < 0.01, "deprecated").otherwise("normal")
    return line.select(
        F.concat(F.lit("Q"), (F.col("l_partkey") + 1).cast("string")).alias("item"),
        F.concat(F.lit("P"), (F.col("l_linenumber") % 3).cast("string")).alias("prop"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), rank.alias("rank"),
        F.col("l_suppkey").cast("string").alias("value"), "l_quantity", "l_extendedprice", "l_suppkey",
    )


# Cells of the home region: those of the first shard.
HOME = "lat0 >= 0 AND lat0 < 40 AND lng0 >= 60 AND lng0 < 100"
