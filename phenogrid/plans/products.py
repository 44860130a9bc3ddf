"""Reference data and tile products: one function per command."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenogrid.operators import naming, raster, rollup, tileset
from phenogrid.operators import places as place_ops
from phenogrid.operators import profiles as profile_ops
from phenogrid.rules import LAND
from phenogrid.session import new_path
from phenogrid.sources import files, sinks


def places(spark: SparkSession, dump: str, admin: str, out: str) -> DataFrame:
    """Place names from a dump: written by chunk, the manifest counts returned."""
    parsed = place_ops.parsed_places(files.geonames_lines(spark, dump))
    named = place_ops.with_admin(place_ops.valid_places(parsed), files.admin_codes(spark, admin))
    sinks.write_places(place_ops.with_chunk(place_ops.with_major(named)), f"{out}/chunks")
    stored = spark.read.json(f"{out}/chunks", schema="name string, lng double, lat double, population bigint, kind int, country string, admin_code string, admin1 string, major boolean, chunk string")
    manifest = place_ops.place_manifest(stored, place_ops.parse_report(parsed))
    sinks.write_small(manifest, f"{out}/manifest")
    return manifest


def profile_candidates(index: DataFrame, featured: DataFrame, done: DataFrame) -> DataFrame:
    """Species that still need a profile: the index and the featured names, minus finished ones."""
    return naming.still_to_do(naming.add_missing(index, featured), done, "sci")


def build_profiles(
    items: DataFrame, chain: DataFrame, pages: DataFrame, media: DataFrame, quantities: DataFrame, claims: DataFrame, aliases: DataFrame, licence_note: str,
) -> DataFrame:
    """Profiles of resolved items from their raw pieces: taxon chain, articles, media, measurements, status claims, aliases."""
    return profile_ops.assemble(
        items, chain, profile_ops.intros(pages), profile_ops.first_images(profile_ops.licensed(media)), profile_ops.quantity_ranges(quantities),
        profile_ops.statuses(claims), profile_ops.other_names(aliases, items.select("item", F.col("label").alias("name"))), licence_note,
    )


def profiles(made: DataFrame, out: str) -> DataFrame:
    """Write profiles and their index, both in ranges of the slug; returns the index. Profiles on disk that are not made
    anew stay, so a run over ``profile_candidates`` adds to earlier ones."""
    spark = made.sparkSession
    if sinks.path_exists(spark, f"{out}/profiles"):
        held = spark.read.schema(made.schema).json(f"{out}/profiles")
        made = made.unionByName(held.join(made.select("slug"), "slug", "left_anti"))
    path = new_path(spark, "profiles")
    made.write.parquet(path)
    stored = spark.read.schema(made.schema).parquet(path)
    sinks.write_documents(stored, f"{out}/profiles", key="slug")
    sinks.write_documents(profile_ops.profile_index(stored), f"{out}/index", key="slug")
    return spark.read.schema("slug string, name string, sci string, thumb string").json(f"{out}/index")


def tiles_world(base: DataFrame, height: int, width: int, levels: dict[int, tuple[int, int]], out: str, tile_px: int = 256) -> None:
    """World levels cut from one base layer, land-bearing tiles only."""
    for z, (out_h, out_w) in levels.items():
        level = raster.cut_level(base, height, width, out_h, out_w).withColumn("z", F.lit(z))
        sinks.write_tiles(raster.on_land_tiles(level, tile_px), out)


def coast_plan(pixels: DataFrame, z: int, tile_px: int = 256) -> DataFrame:
    """Coastal tiles of a level, from a census of its pixels."""
    return raster.coastal_tiles(raster.tile_census(pixels, tile_px), z)


def coast_patch(levels: DataFrame, mask: DataFrame, finest: int, coarsest: int, tile_px: int = 256) -> tuple[DataFrame, DataFrame]:
    """(patched levels, change report per level)."""
    patched = raster.patch_pyramid(levels, mask, finest, coarsest)
    return patched, raster.change_report(patched, tile_px)


def world_from_detail(detail: DataFrame, world: DataFrame, top: int, bottom: int = 0, tile_px: int = 256) -> DataFrame:
    """The world levels above the detail set, rebuilt from its pixels where they exist, up to the coarsest."""
    return rollup.world_levels(detail, world, top, bottom, tile_px)


def true_colour_update(levels: DataFrame, changed: DataFrame, top: int, bottom: int, tile_px: int = 256) -> DataFrame:
    """All true-colour levels after some tiles of the finest changed; only their ancestors are made anew."""
    rebuilt = rollup.changed_levels(levels, changed, top, bottom, tile_px)
    return rollup.replaced(levels, changed, rebuilt, top, bottom, tile_px)


def absorb_shard(served: DataFrame, incoming: DataFrame, shard: tuple[int, int, int], name: str, out: str, tile_px: int = 256, **described) -> DataFrame:
    """One shard's pixels in the place of its old ones, at the levels it brings, and the manifest of the set made anew.

    The set is written to a new place, the manifest last; a drop with pixels outside its shard is refused before.
    """
    spark, xy = served.sparkSession, rollup.tile_of(tile_px)
    pixels = tileset.absorb_shard(served.withColumns(xy), incoming.withColumns(xy), shard).drop("x", "y")
    sinks.write_tiles(pixels, f"{out}/tiles")
    return tile_manifest(spark.read.schema(pixels.schema).parquet(f"{out}/tiles"), name, out, tile_px, **described)


def tile_manifest(pixels: DataFrame, name: str, out: str, tile_px: int = 256, **described) -> DataFrame:
    """Manifest of the land-bearing tiles of a pixel table with a level column, and their bit index beside it."""
    x, y = F.floor(F.col("gx") / tile_px).cast("int").alias("x"), F.floor(F.col("gy") / tile_px).cast("int").alias("y")
    held = pixels.where(F.col("cls") > 0).select("z", x, y).distinct()
    sinks.write_documents(tileset.level_index(held), f"{out}/index", key="chunk")
    made = tileset.manifest(held, name, list(LAND), tile_px=tile_px, **described)
    sinks.write_small(made, f"{out}/manifest")
    return made
