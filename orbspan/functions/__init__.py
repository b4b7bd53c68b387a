from .cells import (
    boundaries,
    cell_resolution,
    centers,
    children_range,
    decode_cell_id,
    encode_cell_id,
    is_cell_id,
    lonlat_to_xyz,
    nested_index,
    nside,
    parent_cell,
    pixel_count,
    xyz_to_lonlat,
)

__all__ = [
    "boundaries",
    "cell_resolution",
    "centers",
    "children_range",
    "decode_cell_id",
    "encode_cell_id",
    "is_cell_id",
    "lonlat_to_xyz",
    "nested_index",
    "nside",
    "parent_cell",
    "pixel_count",
    "xyz_to_lonlat",
]
