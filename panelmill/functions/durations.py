"""Durations such as 1y2m3d4h5min6s: calendar-aware shifts of a moment and multiples."""

from __future__ import annotations

import datetime as dt
import re

# The units in which durations are written, largest first, and how many of each make one of the unit before it.
UNITS = ("y", "m", "d", "h", "min", "s")
MAKE_ONE = {"m": 12, "d": 30, "h": 24, "min": 60, "s": 60}

PART = re.compile(rf"(\d+)({'|'.join(sorted(UNITS, key=len, reverse=True))})")


def parse_duration(text: str) -> dict[str, int]:
    found = PART.findall(text)
    if not found or "".join(a + b for a, b in found) != text:
        raise ValueError(f"not a duration: {text!r}")
    return {unit: sum(int(n) for n, u in found if u == unit) for unit in UNITS}


def shift_datetime(base: dt.datetime, duration: str, mode: str = "sub") -> dt.datetime:
    """Years and months move the calendar and keep the day where the month has it, else its last day."""
    d, sign = parse_duration(duration), {"sub": -1, "add": 1}[mode]
    months = base.year * 12 + base.month - 1 + sign * (12 * d["y"] + d["m"])
    year, month = divmod(months, 12)
    last = (dt.date(year + month // 11, (month + 1) % 12 + 1, 1) - dt.timedelta(days=1)).day
    moved = base.replace(year=year, month=month + 1, day=min(base.day, last))
    return moved + sign * dt.timedelta(days=d["d"], hours=d["h"], minutes=d["min"], seconds=d["s"])


def multiply_duration(k: int, duration: str) -> str:
    """k times the duration, carried into the larger units."""
    n = {unit: k * v for unit, v in parse_duration(duration).items()}
    for large, small in reversed(list(zip(UNITS, UNITS[1:]))):
        carry, n[small] = divmod(n[small], MAKE_ONE[small])
        n[large] += carry
    return "".join(f"{n[unit]}{unit}" for unit in UNITS if n[unit]) or "0s"
