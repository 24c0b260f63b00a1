"""UTM zone 33N (EPSG:25833) to and from longitude/latitude, and web-mercator tiles.

Krüger series in the third flattening (Karney 2011, fourth order) on the GRS80 ellipsoid, written as
SQL text so that the whole transform stays inside generated code.
"""

from __future__ import annotations

import math

from hexloom.functions.numeric import num

_A = 6378137.0
_F = 1 / 298.257222101
_N = _F / (2 - _F)
_K0 = 0.9996
_E0 = 500000.0
_LON0 = 15.0
_ECC = math.sqrt(_F * (2 - _F))
RECTIFYING = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)


def utm33_to_lonlat(x: str, y: str) -> str:
    """Metres to struct(lon, lat) in degrees."""
    xi, eta = f"(({y}) / {num(_K0 * RECTIFYING)})", f"((({x}) - {num(_E0)}) / {num(_K0 * RECTIFYING)})"
    xi1, eta1 = xi, eta
    for j, b in enumerate(BETA, start=1):
        xi1 += f" - {num(b)} * sin({xi} * {2 * j}) * cosh({eta} * {2 * j})"
        eta1 += f" - {num(b)} * cos({xi} * {2 * j}) * sinh({eta} * {2 * j})"
    lat = "p.chi" + "".join(f" + {num(d)} * sin(p.chi * {2 * j})" for j, d in enumerate(DELTA, start=1))
    sphere = "named_struct('chi', asin(sin(t.xi) / cosh(t.eta)), 'lam', atan2(sinh(t.eta), cos(t.xi)))"
    plane = f"named_struct('xi', {xi1}, 'eta', {eta1})"
    point = f"named_struct('lon', {num(_LON0)} + degrees(p.lam), 'lat', degrees({lat}))"
    return _let("t", plane, _let("p", sphere, point))


def lonlat_to_utm33(lon: str, lat: str) -> str:
    """Longitude and latitude in degrees to struct(x, y) in metres."""
    angle = f"named_struct('s', sin(radians({lat})), 'lam', radians(({lon}) - {num(_LON0)}))"
    tangent = (
        f"named_struct('t', sinh(atanh(a.s) - {num(_ECC)} * atanh({num(_ECC)} * a.s)), 'lam', a.lam)"
    )
    sphere = "named_struct('xi', atan2(b.t, cos(b.lam)), 'eta', atanh(sin(b.lam) / sqrt(1D + b.t * b.t)))"
    north, east = "c.xi", "c.eta"
    for j, a in enumerate(ALPHA, start=1):
        north += f" + {num(a)} * sin(c.xi * {2 * j}) * cosh(c.eta * {2 * j})"
        east += f" + {num(a)} * cos(c.xi * {2 * j}) * sinh(c.eta * {2 * j})"
    scale = num(_K0 * RECTIFYING)
    point = f"named_struct('x', {num(_E0)} + {scale} * ({east}), 'y', {scale} * ({north}))"
    return _let("a", angle, _let("b", tangent, _let("c", sphere, point)))


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


#: Latitude at which the square web-mercator map ends.
_EDGE = num(math.degrees(math.atan(math.sinh(math.pi))))


def _in_grid(place: str, zoom: str) -> str:
    """Tile number of a place from 0 to 1; the far edge belongs to the last tile."""
    return f"greatest(least(floor(({place}) * pow(2D, {zoom})), cast(pow(2D, {zoom}) as bigint) - 1L), 0L)"


def tile_x(lon: str, zoom: str) -> str:
    """Web-mercator tile column at ``zoom``, within the map."""
    return _in_grid(f"(({lon}) + 180D) / 360D", zoom)


def tile_y(lat: str, zoom: str) -> str:
    """Web-mercator tile row at ``zoom``, counted from the north, within the map."""
    tangent = f"tan(radians(greatest(least({lat}, {_EDGE}), -{_EDGE})))"
    height = f"ln({tangent} + sqrt({tangent} * {tangent} + 1D)) / {num(math.pi)}"
    return _in_grid(f"(1D - {height}) / 2D", zoom)


def mercator(lon: str, lat: str) -> str:
    """Place on the square web-mercator map: (u, v) from 0 to 1, v counted from the south."""
    tangent = f"tan(radians(greatest(least({lat}, {_EDGE}), -{_EDGE})))"
    height = f"ln({tangent} + sqrt({tangent} * {tangent} + 1D)) / {num(math.pi)}"
    return f"named_struct('u', (({lon}) + 180D) / 360D, 'v', (1D + {height}) / 2D)"


def degrees_text(x: str, y: str) -> str:
    """Longitude and latitude of a place in metres as text, seven decimals."""
    lon, lat = (f"if(p.{c} < 0, -1, 1) * floor(abs(p.{c}) * 1e7D + 0.5D) / 1e7D" for c in ("lon", "lat"))
    return _let("p", utm33_to_lonlat(x, y), f"concat({lon}, ' ', {lat})")
