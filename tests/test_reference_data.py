"""Places, profiles, text, incremental ingest, plans of the reference products."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from phenogrid.functions import text
from phenogrid.operators import counting, places, profiles, quality
from phenogrid.plans import detail, products
from phenogrid.sources import files, shard_store, snapshots
from phenogrid.streaming import shard_drops


FIELDS = {"name": 1, "lat": 4, "lng": 5, "code": 7, "country": 8, "admin": 10, "population": 14}


def dump_row(**values):
    fields = [""] * 19
    for name, value in values.items():
        fields[FIELDS[name]] = str(value)
    return "\t".join(fields)


def test_places(spark):
    """Two large towns, a capital, a village in a chunk, and three lines that are no places."""
    rows = [
        dump_row(name="Havnsund", lat=61.2, lng=5.1, code="PPL", country="NO", admin="09", population=88000),
        dump_row(name="Cuidad Alta", lat=-16.4, lng=-71.5, code="PPLA", country="PE", admin="04", population=16000),
        dump_row(name="Little Isle", lat=1.4, lng=173.1, code="PPLC", country="KI", admin="01", population=900),
        dump_row(name="Kvern", lat=61.9, lng=6.7, code="PPL", country="NO", admin="77", population=1200),
        dump_row(name="Nowhere", lat=12, lng=250, code="PPL", country="NO", admin="09", population=50), "a\tb\tc", "",
    ]
    folder = tempfile.mkdtemp(prefix="dump-")
    with open(f"{folder}/dump.txt", "w") as f:
        f.write("\n".join(rows))
    with open(f"{folder}/admin.txt", "w") as f:
        f.write("NO.09\tVestfold og Fjord\tx\nPE.04\tArequipa\n\tnone\nKI.99\n")
    report = places.parse_report(places.parsed_places(files.geonames_lines(spark, f"{folder}/dump.txt"))).first()
    assert (report["places"], report["malformed"]) == (4, 2)
    manifest = products.places(spark, f"{folder}/dump.txt", f"{folder}/admin.txt", f"{folder}/out").first()
    assert (manifest["major"], manifest["chunked"], manifest["chunks"], manifest["malformed"]) == (3, 1, 1, 2)
    rows = {r["name"]: (r["admin1"], r["kind"], r["chunk"]) for r in spark.read.json(f"{folder}/out/chunks").collect()}
    assert rows["Havnsund"] == ("Vestfold og Fjord", 2, "major") and rows["Cuidad Alta"] == ("Arequipa", 1, "major")
    assert rows["Little Isle"] == ("", 0, "major") and rows["Kvern"] == ("", 2, "8_1")


def test_label_floor():
    assert places.population_floor(30000) == 4_000_000 and places.population_floor(1) == 1000
    assert abs(places.population_floor(1000) - 120_000) < 1e-6 and 120_000 < places.population_floor(1500) < 400_000


def test_ranked_by_population(spark):
    rows = [(f"p{i % 50}", (i * 7919) % 500, "major" if i % 3 else "1_1") for i in range(300)]
    frame = spark.createDataFrame(rows, "name string, population long, chunk string")
    for chunk in ("major", "1_1"):
        got = places.ranked_by_population(frame).where(F.col("chunk") == chunk).orderBy("pos").collect()
        assert [r["pos"] for r in got] == list(range(1, len(got) + 1))
        assert [(-r["population"], r["name"]) for r in got] == sorted((-p, n) for n, p, c in rows if c == chunk)


def test_taxon_chain_depth_and_stop(spark):
    rows = [(i, i + 1, None, f"n{i}") for i in range(1, 15)] + [(15, None, "class", "deep")]
    rows += [(100, 101, None, "s"), (101, 102, "genus", "G"), (102, 103, "class", "C"), (103, 104, "order", "beyond"), (104, None, None, "top"), (200, 999, None, "orphan")]
    nodes = spark.createDataFrame(rows, "node long, parent long, rank string, name string")
    got = {r["node"]: r for r in profiles.taxon_chain(nodes).collect()}
    assert got[3]["class"] == "deep" and got[2]["class"] is None
    assert (got[100]["genus"], got[100]["class"], got[100]["order"]) == ("G", "C", None)
    assert got[200]["class"] is None and got[104]["class"] is None and len(got) == len(rows)


def test_claims(spark):
    rows = [("Q1", "P1", 0, "normal", "a"), ("Q1", "P1", 1, "preferred", "b"), ("Q1", "P1", 2, "deprecated", "c"), ("Q1", "P2", 0, "deprecated", "d")]
    frame = spark.createDataFrame(rows, "item string, prop string, pos int, rank string, value string")
    assert [tuple(r) for r in profiles.best_claims(frame).collect()] == [("Q1", "P1", "b")]


def test_quantities(spark):
    rows = [("Q1", "P2050", 0, "normal", "Q11573", 1.2, 1.1, None), ("Q1", "P2050", 1, "normal", "Q174728", 150.0, None, None), ("Q1", "P2067", 0, "normal", "Q1", 5.0, None, None)]
    frame = spark.createDataFrame(rows, "item string, prop string, pos int, rank string, unit string, amount double, lower double, upper double")
    assert [tuple(r) for r in profiles.quantity_ranges(frame).collect()] == [("Q1", "P2050", 110.0, 150.0, "cm")]


def test_text_functions(spark):
    row = spark.createDataFrame([("<b>A &amp; B</b> &eacute;&nbsp; ", "Bubo  bubo (L.)", "12,5", '=1+"2"', "x female (M).jpg")], "h string, s string, c string, f string, p string").select(
        text.strip_html(F.col("h")), text.slug(F.col("s")), text.csv_field(F.col("c")), text.csv_field(F.col("f")), text.photo_caption(F.col("p")), text.indian_number(F.lit(1234567))
    ).first()
    assert list(row) == ["A & B é", "bubo-bubo-l", '"12,5"', '"\'=1+""2"""', "Female", "12,34,567"]


def test_entities_resolve_as_in_html(spark):
    import html

    samples = ["&amp;lt; &lt;b&gt;", "&eacute&eacute;", "&notit; &notin; &not", "&#65;&#x41;&#X41", "&#0;&#128;&#150;&#55296;&#1114112;&#99999999999999999999;", "a & b &; &zzz; &#; &#x;", "&Aacute;&CounterClockwiseContourIntegral;", "&#1;&#127;|&#xFDD0;|&#13;", "", "none", "&#128512;&frac12;"]
    got = spark.createDataFrame(list(enumerate(samples)), "i int, s string").select("i", text.unescape_html(F.col("s")).alias("t")).collect()
    for r in got:
        assert r["t"] == html.unescape(samples[r["i"]]), samples[r["i"]]
    plan = spark.createDataFrame([("x",)], "s string").select(text.strip_html(F.col("s")))._jdf.queryExecution().toString()
    assert "EvalPython" not in plan


def test_ranges_in_words(spark):
    rows = [(20.0, 30.0, "cm", "20–30 cm", ""), (1200.0, 1800.0, "g", "1.2 kg – 1.8 kg", "Lighter than a bag of rice"), (25.0, 25.0, "g", "25 g", "Lighter than a sparrow"), (900.0, 1000.0, "g", "900 g – 1 kg", "Lighter than a litre of milk")]
    frame = spark.createDataFrame(rows, "lo double, hi double, unit string, words string, compared string")
    got = frame.select("words", "compared", text.range_text(F.col("lo"), F.col("hi"), F.col("unit")), text.weight_comparison(F.col("lo"), F.col("hi"), F.col("unit"))).collect()
    for r in got:
        assert r[0] == r[2] and r[1] == r[3]


def test_entity_dump(spark):
    path = tempfile.mkdtemp(prefix="dump-") + "/e.json"
    with open(path, "w") as f:
        f.write(json.dumps({"id": "Q1", "label": "L", "claims": {"P1": [{"rank": "normal", "value": "x"}, {"rank": "preferred", "value": "y"}]}}) + "\n")
    got = files.entity_claims(files.entity_dump(spark, path)).collect()
    assert [(r["item"], r["prop"], r["pos"], r["value"]) for r in got] == [("Q1", "P1", 0, "x"), ("Q1", "P1", 1, "y")]


def counts(spark, shard_rows):
    rows = [("Species A", "K", "F", "Aves", m, lat, lng, n) for lat, lng, n in shard_rows for m in range(1, 13)]
    return spark.createDataFrame(rows, "sci string, specieskey string, family string, class string, month int, lat0 int, lng0 int, n long")


def test_stream_replaces_shards_once(spark):
    base = tempfile.mkdtemp(prefix="stream-")
    drops, tables, state = f"{base}/drops", f"{base}/tables", f"{base}/state"
    shard_drops.write_drop(counts(spark, [(28, 77, 5), (50, 10, 7)]), drops, 1)
    shard_drops.ingest(spark, drops, tables, state)
    shard_drops.ingest(spark, drops, tables, state)
    read = lambda: {(r["shard"], r["cell"]): r["c"][0] for r in shard_store.pairs(spark, snapshots.latest(spark, tables)).collect()}
    assert read() == {("south-asia", "28_77"): 5, ("europe", "50_10"): 7}
    shard_drops.write_drop(counts(spark, [(51, 11, 9)]), drops, 3)
    shard_drops.ingest(spark, drops, tables, state)
    assert read() == {("south-asia", "28_77"): 5, ("europe", "51_11"): 9}
    shard_drops.write_drop(counts(spark, [(52, 12, 1)]), drops, 2)  # an older version that arrives late
    shard_drops.ingest(spark, drops, tables, state)
    assert read() == {("south-asia", "28_77"): 5, ("europe", "51_11"): 9}


def test_batch_replay_is_idempotent(spark):
    base = tempfile.mkdtemp(prefix="replay-")
    drops, tables = f"{base}/drops", f"{base}/tables"
    shard_drops.write_drop(counts(spark, [(28, 77, 5)]), drops, 1)
    batch = spark.read.schema(shard_drops.DROP_SCHEMA).parquet(drops)
    for _ in range(2):
        shard_drops.replace_shards(batch, drops, tables, ())
    rows = shard_store.pairs(spark, snapshots.latest(spark, tables)).collect()
    assert len(rows) == 1 and rows[0]["c"][11] == 5


def test_a_version_may_arrive_in_two_runs(spark):
    base = tempfile.mkdtemp(prefix="split-")
    drops, tables, state = f"{base}/drops", f"{base}/tables", f"{base}/state"
    for cell in ((28, 77, 5), (10, 70, 2)):
        shard_drops.write_drop(counts(spark, [cell]), drops, 4)
        shard_drops.ingest(spark, drops, tables, state)
    now = snapshots.latest(spark, tables)
    assert {r["cell"]: r["c"][5] for r in shard_store.pairs(spark, now).collect()} == {"28_77": 5, "10_70": 2}
    assert {r["cell"]: r["t"][5] for r in shard_store.effort(spark, now).collect()} == {"28_77": 5, "10_70": 2}


def test_ranges_of_two_classes_share_a_cell(spark):
    """A bird and a turtle in one cell are divided by birds and by reptiles, and come out once each."""
    rows = [(s, "k" + s, c, m, 3, 4, n) for m in range(1, 13) for s, c, n in (("bird", "Aves", 10), ("other bird", "Aves", 90), ("turtle", "Reptilia", 5), ("snake", "Reptilia", 15))]
    seen = spark.createDataFrame(rows, "sci string, specieskey string, class string, month int, lat0 int, lng0 int, n long")
    cells = seen.where("sci IN ('bird', 'turtle')").groupBy("sci").agg(F.lit("3_4").alias("cell"), F.transform(F.array_repeat(F.max("n"), 12), lambda n: n).alias("c"))
    ranges = detail.with_own_effort(cells, seen).withColumns({"key": F.col("sci"), "common": F.lit(""), "family": F.lit("")})
    facets = spark.createDataFrame([("3_4", m, 400, {"9": 40}) for m in range(1, 13)], files.FACET_SCHEMA.replace("cell string,", "cell string, month int,"))
    made = detail.build(facets, spark.createDataFrame([], "key string, sci string, common string, family string"), ranges)
    got = {r["k"]: r["cells"]["3_4"]["r"][0] for r in made["species"].collect()}
    assert got == {"bird": 0.1, "turtle": 0.25, "9": 0.1}
    assert {r["key"]: r["cells"] for r in made["species_index"].collect()} == {"bird": 1, "turtle": 1, "9": 1}


def test_detail_build_with_ranges(spark):
    facets = [("10_76", m, 100, {"1": 10, **({"2": 20} if m in (10, 11) else {})}) for m in range(1, 13)]
    facets += [("11_76", m, 0, {}) for m in range(1, 13)] + [("12_76", m, 5, {"1": 1}) for m in range(1, 12)]
    frame = spark.createDataFrame(facets, files.FACET_SCHEMA.replace("cell string,", "cell string, month int,"))
    names = spark.createDataFrame([("1", "Sci one", "One", "F")], "key string, sci string, common string, family string")
    ranges = spark.createDataFrame(
        [("9", "-20_30", [0] * 11 + [20], [100] * 12, "Sci nine", "", "R"), ("9", "10_76", [5] * 12, [50] * 12, "Sci nine", "", "R")],
        "key string, cell string, c array<bigint>, t array<bigint>, sci string, common string, family string",
    )
    made = detail.build(frame, names, ranges)
    cells = {r["id"]: r for r in made["cells"].collect()}
    assert set(cells) == {"10_76"} and [s["k"] for s in cells["10_76"]["species"]] == ["1", "2"]
    nine = made["species"].where("k = '9'").first()["cells"]
    assert nine["-20_30"]["r"][11] == 0.2 and nine["10_76"]["r"][0] == 0.1
    index = {r["key"]: r for r in made["species_index"].collect()}
    assert index["9"]["name"] == "Sci nine" and index["9"]["cells"] == 2 and index["1"]["name"] == "One" and index["2"]["name"] == "2"


def test_featured_refuses_sensitive(spark):
    with pytest.raises(counting.SensitiveSpeciesError):
        detail.featured_ranges(counts(spark, [(1, 1, 1)]), ["Species A"], ("Species A",))
    rows = detail.featured_ranges(counts(spark, [(1, 1, 50), (60, 60, 0)]), ["Species A"], ()).collect()
    assert [(r["cell"], r["c"], r["t"]) for r in rows] == [("1_1", [50] * 12, [50] * 12)]


def test_shards_own_every_cell_once(spark):
    world = spark.range(180 * 360).selectExpr("cast(id div 360 - 90 AS int) AS lat0", "cast(id % 360 - 180 AS int) AS lng0")
    assert quality.shard_owners(world).where("owners <> 1").count() == 0


def test_no_machine_local_checkpoint_on_a_cluster(spark, monkeypatch):
    from phenogrid import session

    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Fake:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Fake())
    assert os.path.isdir(session.shared_dir(spark))
