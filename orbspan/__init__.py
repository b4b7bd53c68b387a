"""Spherical coverage on Spark: footprints, swaths and the cells they cover."""

from .api import Coverage, boundaries, centers, cover_footprint, cover_swath

__version__ = "0.1.0"
__all__ = ["Coverage", "__version__", "boundaries", "centers", "cover_footprint", "cover_swath"]
