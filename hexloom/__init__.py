"""Analytics over large tables of hexagonal grid cells, written as Spark DataFrame plans."""

from hexloom.operators.attributes import extract_cell_ids, join_attributes
from hexloom.operators.containment import cells_in_polygons, polygon_cover
from hexloom.operators.counts import count_cells, hex_counts, tile_counts, tile_members, tile_pyramid
from hexloom.operators.filter_table import count_filters
from hexloom.operators.filters import apply_filters, parse_filters, predicate
from hexloom.operators.layers import build_cell_pyramid, build_tile_index, hexagons, tile_cover
from hexloom.operators.profile import (
    eligible_columns,
    equal_interval_buckets,
    histogram,
    histograms,
    profile,
    profile_file,
    profile_value_chunks,
    profile_values,
)
from hexloom.operators.selection import (
    cells_in_polygon,
    select_cells,
    select_cells_compact,
    select_cells_polygon,
    uncompact_cells,
)
from hexloom.operators.sketches import approximate_count, distinct_sketch_pyramid
from hexloom.operators.stats import stats

__all__ = [
    "apply_filters",
    "approximate_count",
    "build_cell_pyramid",
    "build_tile_index",
    "cells_in_polygon",
    "cells_in_polygons",
    "count_cells",
    "count_filters",
    "distinct_sketch_pyramid",
    "eligible_columns",
    "equal_interval_buckets",
    "extract_cell_ids",
    "hex_counts",
    "hexagons",
    "histogram",
    "histograms",
    "join_attributes",
    "parse_filters",
    "polygon_cover",
    "predicate",
    "profile",
    "profile_file",
    "profile_value_chunks",
    "profile_values",
    "select_cells",
    "select_cells_compact",
    "select_cells_polygon",
    "stats",
    "tile_counts",
    "tile_cover",
    "tile_members",
    "tile_pyramid",
    "uncompact_cells",
]
