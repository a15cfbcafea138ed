"""Variables, land-cover groups, regions and bands as data.

The names and numbers below are fixed values of the analysis.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Variable:
    """Table and value column of a variable, with its ingest rule: keep below / above, shift in hours, land mask."""

    column: str
    below: float | None = None
    above: float | None = None
    shift_hours: int = 0
    regrid: bool = False
    first_year: int = 2000
    last_year: int = 2020
    increases: bool = False


#: Fill limits, time shifts and year spans of the source products.
VARIABLES = {
    "sm": Variable("sm", below=1e10),
    "vod": Variable("vod", shift_hours=-12, last_year=2018),
    "VODCA_CXKu": Variable("VODCA_CXKu"),
    "rzsm_1m": Variable("rzsm_1m", below=1e10),
    "rzsm_40cm": Variable("rzsm_40cm", below=1e10),
    "rzsm_10cm": Variable("rzsm_10cm", below=1e10),
    "SMroot": Variable("SMroot", below=1e10),
    "SMsurf": Variable("SMsurf", below=1e10),
    "SMrz": Variable("SMrz"),
    "E": Variable("E", below=1e10),
    "net_surface_rad": Variable("net_surface_rad", below=1e10, increases=True),
    "downwelling_surface_sw_rad": Variable("downwelling_surface_sw_rad", below=1e10, increases=True),
    "precipitationCal": Variable("precipitationCal", below=1e30, shift_hours=-12),
    "SIF": Variable("SIF", first_year=2007, last_year=2018),
    "lst_time_corrected": Variable("lst_time_corrected", increases=True),
    "lst-t2m_MW_18": Variable("lst-t2m_MW_18", increases=True),
    "lst_aqua": Variable("lst_aqua", increases=True),
    "t2m": Variable("t2m", regrid=True, increases=True),
    "vimd": Variable("vimd", regrid=True, shift_hours=12),
    "vpd": Variable("vpd", regrid=True, shift_hours=12, increases=True),
    "swvl1": Variable("swvl1", regrid=True, shift_hours=12),
    "wind_speed": Variable("wind_speed", regrid=True, shift_hours=12),
    "GPP": Variable("GPP", above=0.0),
    "ESR": Variable("ESR"),
}

#: Classes of the land-cover legend that form a group.
LAND_COVER_GROUPS = {
    "all_cropland_rainfed": ["cropland_rainfed", "cropland_rainfed_herbaceous_cover", "cropland_rainfed_tree_or_shrub_cover"],
    "all_shrubland": ["shrubland", "shrubland_evergreen", "shrubland_deciduous"],
    "all_sparse_vegetation": ["sparse_vegetation", "sparse_tree", "sparse_shrub", "sparse_herbaceous"],
    "all_tree_cover": [
        "tree_broadleaved_evergreen_closed_to_open", "tree_broadleaved_deciduous_closed_to_open", "tree_broadleaved_deciduous_closed", "tree_broadleaved_deciduous_open",
        "tree_needleleaved_evergreen_closed_to_open", "tree_needleleaved_evergreen_closed", "tree_needleleaved_evergreen_open",
        "tree_needleleaved_deciduous_closed_to_open", "tree_needleleaved_deciduous_closed", "tree_needleleaved_deciduous_open", "tree_mixed",
    ],
    "all_broadleaved": ["tree_broadleaved_evergreen_closed_to_open", "tree_broadleaved_deciduous_closed_to_open", "tree_broadleaved_deciduous_closed", "tree_broadleaved_deciduous_open"],
    "all_needleleaved": ["tree_needleleaved_evergreen_closed_to_open", "tree_needleleaved_deciduous_closed_to_open", "tree_needleleaved_deciduous_closed", "tree_needleleaved_deciduous_open"],
    "all_closed_tree_cover": ["tree_broadleaved_deciduous_closed", "tree_needleleaved_evergreen_closed", "tree_needleleaved_deciduous_closed"],
    "all_broadleaved_deciduous": ["tree_broadleaved_deciduous_closed_to_open", "tree_broadleaved_deciduous_closed", "tree_broadleaved_deciduous_open"],
    "all_needleleaved_evergreen": ["tree_needleleaved_evergreen_closed_to_open", "tree_needleleaved_evergreen_closed", "tree_needleleaved_evergreen_open"],
    "all_needleleaved_deciduous": ["tree_needleleaved_deciduous_closed_to_open", "tree_needleleaved_deciduous_closed", "tree_needleleaved_deciduous_open"],
}

#: The four groups shown on maps.
TOP_LAND_COVERS = ["all_cropland_rainfed", "all_shrubland", "grassland", "all_sparse_vegetation"]

#: West, east, south, north.
REGIONS = {"southern_africa": (12.5, 37.5, -30.0, -12.5), "west_africa": (-18.0, 10.0, 4.0, 20.0), "east_africa": (34.0, 51.5, -2.5, 12.5)}

#: Lower edges of the latitude bands, in the order in which an export lists them.
BANDS = [("north1", 0.0, 20.0), ("north2", 20.0, 40.0), ("north3", 40.0, 50.0), ("north4", 50.0, 60.0), ("north5", 60.0, 70.0), ("north6", 70.0, None), ("south1", None, -30.0), ("south2", -30.0, 0.0)]

#: Fixed value: observations that a daily value needs, a fifth of 625.
LEAST_OBSERVATIONS = 125


def members(group: str, known: list[str] | None = None) -> list[str]:
    """Classes of a group, or the class itself; an unknown class raises KeyError."""
    found = LAND_COVER_GROUPS.get(group, [group])
    if known is not None and (missing := [x for x in found if x not in known]):
        raise KeyError(f"unknown land cover: {missing}")
    return found


def variable(name: str) -> Variable:
    return VARIABLES[name]
