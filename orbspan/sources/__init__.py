from .arrays import coverage_from_arrays, explode_batches, footprints_from_arrays, load_footprints

__all__ = ["coverage_from_arrays", "explode_batches", "footprints_from_arrays", "load_footprints"]
