"""Numeric expressions with one rounding rule for every engine.

Helpers take and return SQL expression text. Long expressions are built as text throughout: one
parse is far cheaper on the driver than hundreds of column calls, and the plan is the same.
"""

from __future__ import annotations


def num(value: float) -> str:
    """A double literal."""
    return f"{float(value)!r}D"


def round_to(value: str, digits: int, signed: bool = False) -> str:
    """Round half away from zero on the binary value; stays in generated code, no decimals.

    ``signed`` is needed only where clearly negative values can occur. From 2^52 steps on a double has no
    digits left to round, and ``floor``, which gives a 64-bit integer, would stop at its largest value;
    such values, infinities and NaN stay as they are.
    """
    scale = num(10.0**digits)
    if signed:
        rounded = f"signum({value}) * (floor(abs({value}) * {scale} + 0.5D) / {scale}) + 0.0D"
    else:
        rounded = f"floor(({value}) * {scale} + 0.5D) / {scale}"
    return f"if(abs({value}) * {scale} < {num(2.0**52)}, {rounded}, cast({value} as double))"


def nearest_int(value: str) -> str:
    """Double to int, ties to the even neighbour."""
    return f"cast(rint({value}) as int)"


def safe_int(text: str) -> str:
    """Text to int: fractions round half away from zero, anything unreadable becomes NULL."""
    number = f"try_cast(trim(cast({text} as string)) as double)"
    return (
        f"CASE WHEN NOT isnan({number}) THEN "
        f"try_cast(signum({number}) * floor(abs({number}) + 0.5D) as int) END"
    )


def ratio(part: str, whole: str) -> str:
    """``part / whole`` as double, NULL when the denominator is zero."""
    return f"try_divide(cast({part} as double), cast({whole} as double))"


def percent(part: str, whole: str, digits: int = 1) -> str:
    """Rounded percentage, NULL when the denominator is zero."""
    return round_to(f"{ratio(part, whole)} * 100D", digits)
