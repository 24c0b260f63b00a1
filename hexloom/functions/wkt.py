"""Geometry text at the edge of the system, as SQL expression text."""

from __future__ import annotations


def point_wkt(x: str, y: str) -> str:
    return f"concat('POINT (', {x}, ' ', {y}, ')')"


def _ring(ring: str) -> str:
    pairs = f"transform(concat({ring}, slice({ring}, 1, 1)), p -> concat(p.x, ' ', p.y))"
    return f"concat('(', array_join({pairs}, ', '), ')')"


def polygon_wkt(rings: str) -> str:
    """Rings (outer first, not closed) to POLYGON text."""
    return f"concat('POLYGON (', array_join(transform({rings}, r -> {_ring('r')}), ', '), ')')"


def multipolygon_wkt(parts: str) -> str:
    """Parts, each an array of rings, to MULTIPOLYGON text."""
    part = f"concat('(', array_join(transform(m, r -> {_ring('r')}), ', '), ')')"
    return f"concat('MULTIPOLYGON (', array_join(transform({parts}, m -> {part}), ', '), ')')"
