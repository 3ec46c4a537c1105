"""Queries against their SQL twins on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, database

NAMES = ["grid_metadata", "grid_cells", "point_to_cell", "quad_point_cell", "normalize_detections", "sessions", "asof_nearest", "asof_claim",
         "merge_flights", "merge_report", "slope_aspect", "terrain_classes", "upsample", "road_fields", "transition_edges", "diffuse", "drift",
         "travel_time", "mpp", "suppress_boost", "negative_search", "tick_fold", "field_range", "kde_surface", "systematic_resample",
         "sortie_schedule", "drone_tracks", "subsample", "throttle", "alerts", "smoothed_rate", "message_routing", "nearest_land",
         "diffuse_tiles", "drift_tiles", "travel_time_tiles", "array_elements", "trail_segments", "track_heads", "cells_in_polygon", "heatmap_delta", "session_match", "attach_gps"]


@pytest.fixture(scope="module")
def db(small):
    return database(small)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, db, small, name):
    result, _, _ = compare(spark, db, name, small, queries()[name], oracle_sql()[name])
    assert result.startswith("ok"), result


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
