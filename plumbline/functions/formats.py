"""Formats of the texts in reports and findings."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

NOT_AVAILABLE = "—"


def _finite(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)


def fixed(x: float, digits: int) -> str:
    return str(Decimal(x).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def percent(ratio: float, digits: int = 1) -> str:
    return f"{fixed(ratio * 100, digits)}%" if _finite(ratio) else NOT_AVAILABLE


def count(n: float) -> str:
    if not _finite(n):
        return NOT_AVAILABLE
    return f"{n:,}" if isinstance(n, int) or n != int(n) else f"{int(n):,}"


def stat(x: float) -> str:
    """Four significant digits."""
    if not _finite(x):
        return NOT_AVAILABLE
    if x == 0:
        return "0"
    rounded = Decimal(x).quantize(Decimal(1).scaleb(math.floor(math.log10(abs(x))) - 3), ROUND_HALF_UP)
    return number(float(rounded))


def number(x: float) -> str:
    """Shortest text that reads back as x; whole numbers without a fraction."""
    return str(int(x)) if x == int(x) and abs(x) < 1e21 else repr(float(x))


def particle(x) -> str:
    """The Korean directional particle after a number, by how its last digit is read."""
    digits = [d for d in str(x) if d.isdigit()]
    return "으로" if digits and digits[-1] in "036" else "로"


def byte_size(n: float) -> str:
    if not _finite(n) or n < 0:
        return NOT_AVAILABLE
    if n < 1024:
        return f"{math.floor(n + 0.5)} B"
    power = min(3, int(math.log(n, 1024)))
    return f"{fixed(n / 1024**power, 1)} {('KB', 'MB', 'GB')[power - 1]}"
