"""Units and health limits of measurement columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

# Unit by column name; a column has the unit of the first entry its name contains.
UNITS = {
    "temperature_2m": "°C",
    "relative_humidity_2m": "%",
    "precipitation": "mm/h",
    "wind_speed_10m": "km/h",
    "wind_direction_10m": "°",
    "surface_pressure": "hPa",
    "cloud_cover": "%",
    "sunshine_duration": "s/h",
    "sunshine_h": "h",
    "NO2": "µg/m³",
    "NO": "µg/m³",
    "O3": "µg/m³",
    "PM10": "µg/m³",
    "PM2": "µg/m³",
}

# WHO air quality limits of 2021 in µg/m³ (NO2 and PM2.5 as annual, PM10 as 24 h, O3 as 8 h mean).
LIMITS = {
    "NO2": 40.0,
    "PM10": 45.0,
    "O3": 100.0,
    "PM2": 15.0,
}


def _lookup(column: str, table: Mapping):
    return next((v for k, v in table.items() if k.lower() in column.lower()), None)


def unit_of(column: str, units: Mapping[str, str] = UNITS) -> str:
    """Unit of a column (P10): of the first entry contained in its name, whatever the case; '' if there is none."""
    return _lookup(column, units) or ""


def units_of(columns: Sequence[str], units: Mapping[str, str] = UNITS) -> dict[str, str]:
    return {c: unit_of(c, units) for c in columns}


def limits_of(columns: Sequence[str], limits: Mapping[str, float] = LIMITS) -> dict[str, float]:
    """Limits of those columns that have one (P11), by the same rule."""
    found = {c: _lookup(c, limits) for c in columns}
    return {c: v for c, v in found.items() if v is not None}
