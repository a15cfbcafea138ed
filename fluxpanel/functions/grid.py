"""Integer arithmetic on regular grids."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RESOLUTION, SOUTH, WEST, ROWS, COLS = 0.25, -60.0, -180.0, 560, 1440


def nearest_index(coord: Column, first_centre: float, step: float = RESOLUTION) -> Column:
    """Index of the cell centre nearest to a coordinate."""
    return F.round((coord - F.lit(first_centre)) / F.lit(step)).cast("int")


def pixel_id(lat: Column, lon: Column, south: float = SOUTH, west: float = WEST, step: float = RESOLUTION, cols: int = COLS) -> Column:
    """One whole number for the cell a point falls nearest to."""
    return nearest_index(lat, south + step / 2, step) * cols + nearest_index(lon, west + step / 2, step)


def tile_index(index: Column, total: int, tiles: int) -> Column:
    """Tile of an index when ``total`` cells are cut into ``tiles`` of ceil size; the last tile takes what is left."""
    return F.least(F.floor(index / F.lit(math.ceil(total / tiles))), F.lit(tiles - 1)).cast("int")


def box_index(index: Column, size: int) -> Column:
    return F.floor(index / F.lit(size)).cast("int")


def coarse_class(code: Column) -> Column:
    """Land-cover code without its last digit."""
    return (F.floor(code / F.lit(10)) * 10).cast("int")


def rounded(coord: Column) -> Column:
    """Coordinates to three places, so that float keys compare."""
    return F.round(coord, 3)
