"""Pointy-top hexagonal grid in planar metres, as SQL expression text.

A cell id packs resolution, q and r into one long, so ids of different resolutions never collide
and one pass can aggregate several resolutions by the id alone.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from hexloom.functions.numeric import num

SQRT3 = math.sqrt(3.0)
#: Edge length in metres at resolution 12; neighbouring resolutions differ by the root of seven.
EDGE_RES12 = 9.4
MAX_RES = 15
_OFFSET = 1 << 27
_MASK = (1 << 28) - 1


def edge_length(res: int) -> float:
    """Edge length (= circumradius) of a cell in metres."""
    return EDGE_RES12 * 7.0 ** ((12 - res) / 2.0)


def origin_cell(res: int) -> int:
    """Packed id of the cell q = r = 0; q and r are added onto it."""
    return (res << 56) + (_OFFSET << 28) + _OFFSET


def pack_cell(res: int, q: str, r: str) -> str:
    """(res, q, r) to one long."""
    return f"({origin_cell(res)}L + ({q}) * {1 << 28}L + ({r}))"


def cell_res(cell: str) -> str:
    return f"cast(shiftrightunsigned({cell}, 56) as int)"


def cell_q(cell: str) -> str:
    return f"((shiftrightunsigned({cell}, 28) & {_MASK}L) - {_OFFSET}L)"


def cell_r(cell: str) -> str:
    return f"(({cell} & {_MASK}L) - {_OFFSET}L)"


def cell_edge(cell: str) -> str:
    """Edge length of a cell, from literals so that every use sees the same double."""
    lengths = ", ".join(num(edge_length(res)) for res in range(MAX_RES + 1))
    return f"get(array({lengths}), {cell_res(cell)})"


def cell_string(cell: str) -> str:
    """Text form of a cell id."""
    return f"lower(hex({cell}))"


def _grid(res: int) -> tuple[str, str, str]:
    """Column pitch, double row pitch and origin id of a resolution."""
    size = edge_length(res)
    return num(SQRT3 * size), num(3.0 * size), f"{origin_cell(res)}L"


def _nearest(x: str, y: str, pitch: str, rows: str, origin: str) -> str:
    """Centres form two interleaved rectangular lattices; the nearest one of each is a rounding, and
    the closer of the two wins."""
    u, v = f"(({x}) / {pitch})", f"(({y}) / {rows})"
    even_i, even_j = f"floor({u} + 0.5D)", f"floor({v} + 0.5D)"
    odd_i, odd_j = f"floor({u})", f"floor({v})"

    def distance(du: str, dv: str) -> str:
        return f"(({du}) * ({du}) + ({dv}) * ({dv}) * 3D)"

    def cell(i: str, j: str, odd: int) -> str:
        # q = i - j and r = 2j + odd
        return f"({origin} + ({i} - {j}) * {1 << 28}L + 2 * {j} + {odd})"

    to_even = distance(f"{u} - {even_i}", f"{v} - {even_j}")
    to_odd = distance(f"{u} - {odd_i} - 0.5D", f"{v} - {odd_j} - 0.5D")
    return (
        f"CASE WHEN {to_even} <= {to_odd} THEN {cell(even_i, even_j, 0)} "
        f"ELSE {cell(odd_i, odd_j, 1)} END"
    )


def hex_cell(x: str, y: str, res: int) -> str:
    """Cell holding a point at one resolution."""
    return _nearest(x, y, *_grid(res))


def hex_grids(resolutions: Sequence[int]) -> str:
    """Array of grid parameters, to be exploded with ``inline`` ahead of ``hex_cell_any``.

    One expression then serves all resolutions; one per resolution would outgrow the JIT compiler.
    """
    grids = (_grid(res) for res in resolutions)
    return "array(" + ", ".join(
        f"named_struct('pitch', {p}, 'rows', {r}, 'origin', {o})" for p, r, o in grids
    ) + ")"


def hex_cell_any(x: str, y: str) -> str:
    """Cell holding a point on the grid given by the columns of ``hex_grids``."""
    return _nearest(x, y, "pitch", "rows", "origin")


def hex_center(cell: str) -> str:
    """struct(x, y) of the cell centre."""
    size, q, r = cell_edge(cell), cell_q(cell), cell_r(cell)
    return (
        f"named_struct('x', {size} * {num(SQRT3 / 2.0)} * ({q} * 2 + {r}), "
        f"'y', {size} * 1.5D * {r})"
    )


def hex_boundary(cell: str) -> str:
    """Six corners, counter-clockwise from the bottom.

    Corners come from whole multiples of half steps, so neighbouring cells share them bit for bit.
    """
    size, q, r = cell_edge(cell), cell_q(cell), cell_r(cell)
    corners = ", ".join(
        f"named_struct('x', h.w * (h.i + {dx}), 'y', h.h * (h.j + {dy}))"
        for dx, dy in ((0, -2), (1, -1), (1, 1), (0, 2), (-1, 1), (-1, -1))
    )
    half_steps = (
        f"named_struct('w', {size} * {num(SQRT3 / 2.0)}, 'h', {size} * 0.5D, "
        f"'i', {q} * 2 + {r}, 'j', {r} * 3)"
    )
    return f"get(transform(array({half_steps}), h -> array({corners})), 0)"


def disk_offsets(k: int) -> list[tuple[int, int]]:
    """Axial offsets of all cells within ``k`` steps: 3k(k+1)+1 of them."""
    return [
        (dq, dr)
        for dq in range(-k, k + 1)
        for dr in range(max(-k, -dq - k), min(k, -dq + k) + 1)
    ]


def disk_cells(cell: str, k: int) -> str:
    """Array of the ids within ``k`` steps. Offsets add directly onto the packed id."""
    return "array(" + ", ".join(f"{cell} + {(dq << 28) + dr}L" for dq, dr in disk_offsets(k)) + ")"
