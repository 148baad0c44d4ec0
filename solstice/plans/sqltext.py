"""Small SQL text builders shared by the SQL equivalents."""

from __future__ import annotations


def pmod(x: str, n) -> str:
    return f"(CASE WHEN ({x}) % {n} < 0 THEN (({x}) % {n} + {n}) % {n} ELSE ({x}) % {n} END)"


def half_up(x: str) -> str:
    return f"floor({x} + 0.5)"


def half_even(x: str) -> str:
    return f"CAST(round_even({x}, 0) AS DOUBLE)"


def half_down(x: str) -> str:
    return f"ceil({x} - 0.5)"


def cell_text(lat: str, lon: str) -> str:
    return f"format('{{:+06.1f}}_{{:+07.1f}}', {lat} + 0.0::DOUBLE, {lon} + 0.0::DOUBLE)"


def cell_lat(lat: str, tie=half_up) -> str:
    return f"greatest(-89.0::DOUBLE, least(89.0::DOUBLE, {tie(f'(({lat}) + 1) / 2')} * 2 - 1))"


def cell_lon(lon: str, tie=half_up) -> str:
    return f"({pmod(tie(f'(({lon}) + 1) / 2') + ' * 2 - 1 + 179', 360)} - 179)"


def cell(lat: str = "lat", lon: str = "lon", tie=half_up) -> str:
    return cell_text(cell_lat(lat, tie), cell_lon(lon, tie))


def lat_index(lat: str) -> str:
    return f"CAST(greatest(0, least(89, ceil((({lat}) + 89) / 2 - 0.5))) AS INT)"


def lon_index(lon: str) -> str:
    return f"CAST(greatest(0, least(179, ceil(({pmod(f'({lon}) + 180', 360)} - 180 + 179) / 2 - 0.5))) AS INT)"


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"(2 * 6371 * asin(sqrt(pow(sin(radians(({lat2}) - ({lat1})) / 2), 2)"
        f" + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians(({lon2}) - ({lon1})) / 2), 2))))"
    )


def ring(first: str, offset: str) -> str:
    return f"CAST({pmod(f'({first}) - 1 + ({offset})', 12)} + 1 AS INT)"


SEASON_LIST = "['DJF','JFM','FMA','MAM','AMJ','MJJ','JJA','JAS','ASO','SON','OND','NDJ']"
MONTH_LIST = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']"
