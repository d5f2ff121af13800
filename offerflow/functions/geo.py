"""Points and grid cells.

A cell's id packs scale, latitude index and longitude index into 16, 24 and 24
bits. Scale 500 is a cell of about five kilometres.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Degrees of latitude and longitude for a step of scale 1; the default and largest scale.
LAT_STEP = 8.9877e-5
LON_STEP = 1.12346e-4
DEFAULT_SCALE = 500
MOST_SCALE = 32767
#: The point that stands for "no result"; it has no cell.
NOWHERE = "90.0000000,0.0000000"


def _check(scale: int) -> None:
    if not 1 <= scale <= MOST_SCALE:
        raise ValueError(f"scale must be 1 to {MOST_SCALE}")


def parse_point(c: Column) -> Column:
    """``lat,lon`` as a struct; further pieces are ignored; null if malformed or out of range."""
    parts = F.split(c, ",")
    lat, lon = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("lat"), lon.alias("lon")))


def lat_index(lat: Column, scale: int = DEFAULT_SCALE) -> Column:
    return F.floor((lat + 90.0) / F.lit(LAT_STEP * scale))


def lon_index(lon: Column, scale: int = DEFAULT_SCALE) -> Column:
    return F.floor((lon + 180.0) / F.lit(LON_STEP * scale))


def cell_id(lat: Column, lon: Column, scale: int = DEFAULT_SCALE) -> Column:
    _check(scale)
    return F.lit(scale << 48) + F.shiftleft(lat_index(lat, scale), 24) + lon_index(lon, scale)


def decode_cell(c: Column) -> Column:
    mask = F.lit((1 << 24) - 1)
    return F.struct(F.shiftright(c, 48).alias("scale"), F.shiftright(c, 24).bitwiseAND(mask).alias("lat_index"), c.bitwiseAND(mask).alias("lon_index"))


def cell_corner(c: Column) -> Column:
    """The south-western corner."""
    d = decode_cell(c)
    return F.struct((d["lat_index"] * (d["scale"] * F.lit(LAT_STEP)) - 90.0).alias("lat"), (d["lon_index"] * (d["scale"] * F.lit(LON_STEP)) - 180.0).alias("lon"))
