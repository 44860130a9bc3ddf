"""Registered queries against their SQL on the smallest tables (all of them: tools/check_oracle.py)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry
from check_oracle import TABLES, rows_of

SAMPLE = (
    "a01_count_records", "a02_month_pivot", "a06_shard_metrics", "a11_cell_documents", "a20_block_mode", "a23_mean_of_years", "a31_drill_down", "a33_coverage_manifest",
    "a39_reach", "a19_effort_by_class", "x02_detail_build", "x02_publish_in_place", "x02_world_build", "j20_environment_lines", "a37_profiles", "sk12_tile_manifest", "e03_presence", "e08_layer_bytes", "e24_range_text", "f08_box_predicate", "f13_filter_chips", "g10_tiles_in_boxes", "g13_hilbert_order", "j05_resolve_names",
    "j12_coastal_tiles", "j14_derive_coarse", "j16_sample_layer", "j17_resolve_items", "r02_bilinear", "sc01_counts_tsv", "sc06_place_dump", "sk01_replace_shard", "sk06_place_csv",
    "st01_shard_drops", "t02_species_search", "u05_other_names", "u07_absorb_shard", "w05_reported_tier", "w08_journey_legs", "w09_quantile_picks", "w11_hillshade",
)


@pytest.fixture(scope="module")
def con(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, sf_dir, con, name):
    frame = entry.queries()[name](spark, sf_dir)
    got = rows_of(frame.columns, frame.collect())
    cursor = con.execute(entry.oracle_sql()[name])
    rows = cursor.fetchall()
    assert got == rows_of([d[0] for d in cursor.description], rows) and got[1]


def test_entry(spark):
    assert set(entry.entry(spark).columns) == {"sci", "cell", "p", "records", "months_present"}
