"""Derived measures of a cell or area, as SQL expression text."""

from __future__ import annotations

from hexloom.functions.numeric import ratio, round_to


def area_metrics(area_m2: str, forest_m2: str, trees: str) -> dict[str, str]:
    """Square kilometres, clamped usable area, forest cover and density of one cell or area."""
    forest = f"coalesce({forest_m2}, 0D)"
    usable = f"(greatest({area_m2} - {forest}, 0D) / 1e6D)"
    cover = f"CASE WHEN {area_m2} > 0 THEN least({forest} / {area_m2} * 100D, 100D) ELSE 0D END"
    return {
        "berlin_area_km2": round_to(f"{area_m2} / 1e6D", 4),
        "forest_area_km2": round_to(f"{forest} / 1e6D", 4),
        "non_forest_area_km2": round_to(usable, 4),
        "forest_cover_pct": round_to(cover, 1),
        "tree_density_km2": round_to(ratio(f"coalesce({trees}, 0)", usable), 1),
    }


def _cap(p95: str) -> str:
    return f"greatest(coalesce(cast({p95} as double), 0D), 2D)"


def suppress_artefacts(density: str, cover_pct: str, p95: str) -> str:
    """Zero where little usable land inflates the density."""
    value, cover = f"coalesce({density}, 0D)", f"coalesce({cover_pct}, 0D)"
    return (
        f"CASE WHEN ({cover} > 85 AND {value} > {_cap(p95)}) OR {cover} > 95 "
        f"THEN 0D ELSE {value} END"
    )


def cover_band(cover_pct: str) -> str:
    """'trees' below 33 % forest, 'forest' above 67 %, 'both' between."""
    cover = f"coalesce({cover_pct}, 0D)"
    return f"CASE WHEN {cover} < 33 THEN 'trees' WHEN {cover} > 67 THEN 'forest' ELSE 'both' END"


def clamp_top(quantiles: str, p95: str) -> str:
    """Replace the last breakpoint by max(p95, last but one + 1)."""
    top = f"greatest(cast({p95} as double), element_at({quantiles}, -2) + 1D)"
    return (
        f"CASE WHEN size({quantiles}) >= 2 THEN "
        f"concat(slice({quantiles}, 1, size({quantiles}) - 1), array({top})) END"
    )


def ascending_stops(quantiles: str) -> str:
    """Breakpoints made strictly ascending by nudging ties 1e-6 upwards."""
    last = "element_at(done, -1)"
    step = f"concat(done, array(CASE WHEN v <= {last} THEN {last} + 1e-6D ELSE v END))"
    return (
        f"aggregate(slice({quantiles}, 2, greatest(size({quantiles}) - 1, 0)), "
        f"slice({quantiles}, 1, 1), (done, v) -> {step})"
    )


def density_rank(value: str, stops: str, p95: str) -> str:
    """Rank in [0, 1] on the piecewise-linear distribution through ``stops``.

    Without at least two stops, a straight ramp up to max(p95, 2).
    """
    below = f"size(filter({stops}, q -> q <= {value}))"
    low, high = f"get({stops}, {below} - 1)", f"get({stops}, {below})"
    last = f"(size({stops}) - 1)"
    inner = f"({below} - 1 + ({value} - {low}) / ({high} - {low})) / {last}"
    return (
        f"CASE WHEN {stops} IS NULL OR size({stops}) < 2 "
        f"THEN least(greatest({value}, 0D) / {_cap(p95)}, 1D) "
        f"WHEN {below} = 0 THEN 0D WHEN {below} > {last} THEN 1D ELSE {inner} END"
    )
