from hexloom.sources.index import append_tile_index, read_tile_index
from hexloom.sources.readers import (
    build_cells,
    coarse_position,
    csv_with_verdicts,
    narrow_schema,
    read_cells_csv,
    read_coarse_csv,
    read_features,
    read_id_csv,
    read_id_list,
    read_profile,
    row_count,
    with_hierarchy,
)
from hexloom.sources.writers import (
    STORED_LEVELS,
    export_csv,
    geojson_features,
    write_cell_pyramid,
    write_cells,
    write_geojson,
    write_id_list,
    write_joined_csv,
    write_profile,
    write_tile_index,
)

__all__ = [
    "STORED_LEVELS",
    "append_tile_index",
    "build_cells",
    "coarse_position",
    "csv_with_verdicts",
    "export_csv",
    "geojson_features",
    "narrow_schema",
    "read_cells_csv",
    "read_coarse_csv",
    "read_features",
    "read_id_csv",
    "read_id_list",
    "read_profile",
    "read_tile_index",
    "row_count",
    "with_hierarchy",
    "write_cell_pyramid",
    "write_cells",
    "write_geojson",
    "write_id_list",
    "write_joined_csv",
    "write_profile",
    "write_tile_index",
]
