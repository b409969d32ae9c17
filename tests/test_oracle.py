"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from check import TABLES, canon

FOLDER = "/root/testdata/sf0.001"
# one or two per family; check.py compares all of them
NAMES = [
    "src2_csv_encoding_fallback", "src3_api_items", "src5_load_years", "src6_geojson_features", "snk2_save_grid_geojson",
    "cln1_coerce_numeric", "mis2_fill_median", "val1_validate_dataset", "prj2_unpivot_years", "jn1_point_in_cell",
    "jn3_point_in_polygon", "jn4_cell_polygon_overlap", "jn5_nearest_site", "jn10_interval_join", "jn11_rain_before",
    "jn12_gazetteer_lookup", "ag5_pipe_features", "ag16_hourly_quantile", "ag18_histogram", "ag29_lag_response", "wn1_rolling_sums",
    "wn2_top_events", "wn3_event_sessions", "wn4_percent_rank_rows", "wn6_focal_mean", "wn7_hot_spots", "tk1_priority_top20",
    "sf2_mask_pii", "sf12_reproject_round_trip", "tr4_flow_direction", "tr5_flow_accumulation", "in2_idw_leave_one_out",
    "nm5_jenks_exact", "sc10_cdri_geometric", "wt2_ahp_weights", "vl1_roc_auc", "vl2_pr_auc", "vl6_spearman", "vl7_kappa",
    "sn1_weight_sensitivity", "sn3_rank_scenarios", "ml3_group_folds", "ml10_holdout_split", "st1_hourly_rain", "st3_rain_sessions",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def test_every_sql_belongs_to_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry_has_rows(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["grid_id", "flood_score", "sewer_score", "vuln_score", "risk_score", "risk_grade"]
    assert len(df.collect()) == 20


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    got = entry_points.queries()[name](spark, FOLDER).toPandas()
    want = con.execute(entry_points.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)
