from .balance import balanced_join, balanced_map, counts_with_total, partial_counts, plan_load
from .cover import (
    coverage_offsets,
    cover_arrays,
    cover_counts,
    cover_footprint,
    cover_lonlat,
    cover_ranges,
    validate_footprints,
)
from .near import near_pairs, points_in_footprints
from .swath import cover_swath, swath_footprints

__all__ = [
    "balanced_join",
    "balanced_map",
    "counts_with_total",
    "cover_arrays",
    "cover_counts",
    "cover_footprint",
    "cover_lonlat",
    "cover_ranges",
    "cover_swath",
    "coverage_offsets",
    "near_pairs",
    "partial_counts",
    "plan_load",
    "points_in_footprints",
    "swath_footprints",
    "validate_footprints",
]
