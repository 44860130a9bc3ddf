"""Species profiles from knowledge-base entities, articles and media records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from phenogrid.functions import text
from phenogrid.rules import MAX_IMAGES, MAX_OTHER_NAMES, PARENT_LEVELS, STATUS, TAXON_RANKS, UNITS
from phenogrid.session import cut_lineage


def literal_map(column: Column, table: dict, part: int | None = None) -> Column:
    """Look a value up in a short fixed table; NULL when it is not there."""
    chain = F.lit(None)
    for known, value in table.items():
        chain = F.when(column == known, F.lit(value if part is None else value[part])).otherwise(chain)
    return chain


def best_claims(claims: DataFrame, limit: int | None = 1) -> DataFrame:
    """Claims of each (item, prop) without deprecated ones, preferred rank first, else as stated.

    With ``limit=1`` the first one is a ``min_by`` with map-side combining; a longer list is the
    claims of one property of one entity document.
    """
    usable = claims.where(F.col("rank") != "deprecated")
    order = F.struct((F.col("rank") != "preferred").alias("later"), F.col("pos"))
    if limit == 1:
        return usable.groupBy("item", "prop").agg(F.min_by("value", order).alias("value"))
    w = Window.partitionBy("item", "prop").orderBy(F.col("rank") != "preferred", "pos")
    ranked = usable.withColumn("place", F.row_number().over(w))
    return ranked if limit is None else ranked.where(F.col("place") <= limit)


def resolve_items(species: DataFrame, claims: DataFrame, articles: DataFrame, key_prop: str, name_prop: str) -> DataFrame:
    """Best entity per species: matches by key or by name, most matches, then an article, then the
    lowest id. ``species`` has sci, k; the two matches are equi joins, never a product."""
    stated = claims.where(F.col("rank") != "deprecated").where(F.col("prop").isin(key_prop, name_prop)).select("item", "prop", "value").distinct()
    by_key = species.where(F.col("k").isNotNull()).join(
        stated.where(F.col("prop") == key_prop).select("item", F.col("value").alias("k")), "k"
    ).select("sci", "item")
    by_name = species.join(stated.where(F.col("prop") == name_prop).select("item", F.col("value").alias("sci")), "sci").select("sci", "item")
    scored = by_key.unionByName(by_name).groupBy("sci", "item").agg(F.count("*").alias("matches"))
    with_article = scored.join(articles.select("item", F.lit(1).alias("_a")).distinct(), "item", "left")
    number = F.regexp_extract("item", r"(\d+)", 1).cast("long")
    order = F.struct("matches", F.coalesce("_a", F.lit(0)).alias("article"), (-number).alias("low"))
    return with_article.groupBy("sci").agg(F.max_by(F.struct("item", "matches"), order).alias("b")).select("sci", "b.*")


RANKS = ("genus", "family", "order", "class")


def taxon_chain(nodes: DataFrame, levels: int = PARENT_LEVELS) -> DataFrame:
    """First genus, family, order and class above every node, at most ``levels`` steps up, stopping
    at the class.

    ``nodes`` has node, parent, rank, name. Pointers are doubled: a round joins every node's state
    to the state of the node its pointer names, so 12 levels take 4 joins, not 12. Finished nodes
    (class found or no parent) leave the join, which also keeps NULL pointers out of the shuffle.
    """
    stated = nodes.select(
        "node", F.when(F.col("parent") != F.col("node"), F.col("parent")).alias("parent"),
        *[F.when(F.col("rank") == r, F.col("name")).alias(r) for r in RANKS],
    )
    above = stated.select(F.col("node").alias("parent"), F.lit(True).alias("_there"), *[F.col(r).alias(f"_{r}") for r in RANKS])
    # One step: what the parent is. ``ptr`` is the last node looked at, NULL once the walk is over.
    one = stated.select("node", "parent").join(above, "parent", "left").select(
        "node", *[F.col(f"_{r}").alias(r) for r in RANKS], F.when(F.col("_there") & F.col("_class").isNull(), F.col("parent")).alias("ptr"),
    )
    steps = {1: cut_lineage(one)}
    have = 1
    while have * 2 <= levels:
        steps[have * 2] = cut_lineage(_jump(steps[have], steps[have]))
        have *= 2
    state, done = steps[have], have
    for size in sorted(steps, reverse=True):
        if done + size <= levels:
            state, done = _jump(state, steps[size]), done + size
    return state.select("node", *RANKS)


def _jump(lower: DataFrame, upper: DataFrame) -> DataFrame:
    """State of a walk of the lower's length followed by one of the upper's length.

    A walk that ended at ``ptr`` goes on with the state of ``ptr``, which starts one step above it.
    """
    ahead = upper.select(F.col("node").alias("ptr"), F.col("ptr").alias("_ptr"), *[F.col(r).alias(f"_{r}") for r in RANKS])
    going = lower.where(F.col("ptr").isNotNull()).join(ahead, "ptr", "left").select(
        "node", *[F.coalesce(r, f"_{r}").alias(r) for r in RANKS], F.col("_ptr").alias("ptr"),
    )
    return going.unionByName(lower.where(F.col("ptr").isNull()))


def final_titles(titles: DataFrame, normalized: DataFrame, redirects: DataFrame) -> DataFrame:
    """Requested title to final title: through the normalised form, then the redirect."""
    n = normalized.select(F.col("source").alias("title"), F.col("target").alias("_n"))
    r = redirects.select(F.col("source").alias("_t"), F.col("target").alias("_r"))
    return (
        titles.join(n, "title", "left").withColumn("_t", F.coalesce("_n", "title"))
        .join(r, "_t", "left").select("title", F.coalesce("_r", "_t").alias("final"))
    )


def intros(pages: DataFrame) -> DataFrame:
    """First non-empty paragraph of existing articles that are no disambiguation pages.

    ``pages`` has sci, linked, extract, disambiguation, missing; an article nobody linked counts
    only if it mentions the scientific name.
    """
    paragraph = F.coalesce(F.get(F.filter(F.transform(F.split("extract", "\n"), lambda p: F.trim(p)), lambda p: p != ""), F.lit(0)), F.lit(""))
    kept = pages.where(~F.col("missing") & ~F.col("disambiguation")).withColumn("intro", paragraph)
    return kept.where(F.col("linked") | F.contains(F.lower("intro"), F.lower("sci"))).drop("extract", "missing", "disambiguation")


def quantity_ranges(quantities: DataFrame) -> DataFrame:
    """Range per (item, prop) over amounts and bounds, in centimetres or grams.

    ``quantities`` has item, prop, pos, rank, unit, amount, lower, upper; unknown units are left out. The
    unit of the result is that of the last usable claim.
    """
    factor = literal_map(F.col("unit"), UNITS, 1).cast("double")
    target = literal_map(F.col("unit"), UNITS, 0).cast("string")
    known = quantities.withColumns({"_f": factor, "_u": target}).where(F.col("_f").isNotNull())
    lowest = F.least(F.col("amount"), F.col("lower"), F.col("upper")) * F.col("_f")
    highest = F.greatest(F.col("amount"), F.col("lower"), F.col("upper")) * F.col("_f")
    stated = F.struct((F.col("rank") != "preferred").alias("later"), F.col("pos"))
    return known.where(F.col("rank") != "deprecated").groupBy("item", "prop").agg(
        F.round(F.min(lowest), 1).alias("lo"), F.round(F.max(highest), 1).alias("hi"), F.max_by("_u", stated).alias("unit"),
    ).where(F.col("lo").isNotNull())


def statuses(claims: DataFrame) -> DataFrame:
    """Conservation status per item: the first claim whose value is a known status."""
    code, label = literal_map(F.col("value"), STATUS, 0), literal_map(F.col("value"), STATUS, 1)
    known = claims.where(F.col("rank") != "deprecated").withColumns({"code": code, "label": label}).where(F.col("code").isNotNull())
    order = F.struct((F.col("rank") != "preferred").alias("later"), F.col("pos"))
    return known.groupBy("item").agg(F.min_by(F.struct("code", "label"), order).alias("s")).select("item", "s.*")


def rank_names(rank_item: Column) -> Column:
    return literal_map(rank_item, TAXON_RANKS)


def licensed(media: DataFrame) -> DataFrame:
    """Media with a known licence only."""
    return media.withColumn("license", text.clean(F.col("license"))).where(F.col("license").isNotNull())


def first_images(media: DataFrame, limit: int = MAX_IMAGES) -> DataFrame:
    """The first files of each item, in the order they are stated."""
    w = Window.partitionBy("item").orderBy("pos")
    return media.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def other_names(aliases: DataFrame, excluded: DataFrame, limit: int = MAX_OTHER_NAMES) -> DataFrame:
    """Aliases per item without case-only repeats and without the excluded names, order kept.

    ``aliases`` has item, pos, alias; ``excluded`` has item, name. The first spelling wins through
    ``min_by``, before anything is ranked.
    """
    trimmed = aliases.withColumn("alias", F.trim("alias")).where(F.col("alias") != "").withColumn("_low", F.lower("alias"))
    first = trimmed.groupBy("item", "_low").agg(F.min_by("alias", "pos").alias("alias"), F.min("pos").alias("pos"))
    kept = first.join(excluded.select("item", F.lower("name").alias("_low")), ["item", "_low"], "left_anti")
    w = Window.partitionBy("item").orderBy("pos")
    return kept.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("item", "place", "alias")


def assemble(
    items: DataFrame, taxonomy: DataFrame, intro: DataFrame, images: DataFrame, facts: DataFrame, status: DataFrame, aliases: DataFrame, licence_note: str,
) -> DataFrame:
    """One profile per species from its pieces; a missing piece is NULL, which JSON leaves out.

    ``items`` has sci, item, label, title, common, family and description. The sources name the entity and, where an
    article was used, its address. Images and names are capped per item by the product itself, so the lists are short.
    """
    photos = images.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "url", "thumb", "license", "caption"))), lambda x: x.dropFields("place")).alias("images"))
    names = aliases.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "alias"))), lambda x: x["alias"]).alias("other_names"))
    measured = facts.groupBy("item").agg(*[
        F.max(F.when(F.col("prop") == p, F.struct("lo", "hi", "unit"))).alias(p) for p in ("wingspan", "length", "mass")
    ])
    ranks = taxonomy.withColumnRenamed("family", "_family")
    joined = (
        items.join(ranks, "item", "left").join(intro.select("sci", "intro", "url"), "sci", "left")
        .join(photos, "item", "left").join(measured, "item", "left").join(names, "item", "left")
        .join(status.select("item", F.struct("code", "label").alias("status")), "item", "left")
    )
    family = F.coalesce("_family", F.nullif(F.col("family"), F.lit("")))
    entity = F.struct(F.lit("entity").alias("label"), F.col("item").alias("at"))
    article = F.struct(F.lit("article").alias("label"), F.col("url").alias("at"))
    return joined.select(
        text.slug(F.col("sci")).alias("slug"), F.col("sci").alias("scientific"),
        text.display_name(F.col("sci"), F.col("label"), F.col("common"), F.col("title")).alias("name"), F.col("item").alias("qid"),
        F.coalesce("description", F.lit("")).alias("description"), F.coalesce("intro", F.lit("")).alias("extract"), "images",
        F.struct("wingspan", "length", "mass", "status").alias("facts"),
        F.struct(F.col("genus"), family.alias("family"), F.col("order"), F.col("class")).alias("taxonomy"),
        "other_names", F.when(F.col("url").isNull(), F.array(entity)).otherwise(F.array(entity, article)).alias("sources"), F.lit(licence_note).alias("licence_note"),
    )


def profile_index(profiles: DataFrame) -> DataFrame:
    """slug -> name, scientific name and the first image's thumbnail."""
    return profiles.select("slug", "name", F.col("scientific").alias("sci"), F.get("images", F.lit(0))["thumb"].alias("thumb"))
