"""Figures: bounded results for people. The only place that rounds and collects."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

MOST = 512
CHART_KINDS = ("line", "bar", "hist", "band", "scatter", "heat", "table", "bullet", "drawdown")


class TooLarge(ValueError):
    """A figure holds more than ``MOST`` items."""


def guard(value, path: str = "figures"):
    """The value itself; anything in it with more than 512 items, lists and mappings alike, is an error."""
    if isinstance(value, dict | list | tuple | set):
        if len(value) > MOST:
            raise TooLarge(f"{path}: {len(value)} items, at most {MOST}")
        for k, v in value.items() if isinstance(value, dict) else enumerate(value):
            guard(v, f"{path}.{k}")
    return value


def tidy(value, places: int = 6):
    if isinstance(value, float):
        return round(value, places) if math.isfinite(value) else None
    if isinstance(value, dict):
        return {k: tidy(v, places) for k, v in value.items()}
    return [tidy(v, places) for v in value] if isinstance(value, list | tuple) else value


def rows_of(df: DataFrame, places: int = 6) -> list[dict]:
    """A small result as dictionaries; one row more than allowed is read, so that a large one is refused and not cut."""
    rows = [r.asDict(recursive=True) for r in df.limit(MOST + 1).collect()]
    return guard(tidy(rows, places))


def chart(kind: str, key: str, title: str) -> dict[str, str]:
    if kind not in CHART_KINDS:
        raise ValueError(f"{kind!r} is none of {', '.join(CHART_KINDS)}")
    return {"kind": kind, "key": key, "title": title}
