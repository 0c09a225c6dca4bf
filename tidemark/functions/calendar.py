"""Seasonal and holiday features as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_days(ds: Column) -> Column:
    """Days since the epoch, with fraction."""
    return F.unix_timestamp(ds.cast("timestamp")) / 86_400.0


def fourier_features(ds: Column, period_days: float, order: int) -> list[Column]:
    """sin, cos pairs up to ``order`` for a period in days."""
    t = epoch_days(ds)
    out = []
    for n in range(1, order + 1):
        angle = (2.0 * math.pi * n / period_days) * t
        out += [F.sin(angle), F.cos(angle)]
    return out


def conditional_seasonality(ds: Column, order: int) -> list[Column]:
    """Daily terms split in two: the first half acts on weekdays, the second at weekends."""
    weekday = F.when(F.weekday(ds) < 5, 1.0).otherwise(0.0)
    terms = fourier_features(ds, 1.0, order)
    return [f * weekday for f in terms] + [f * (1.0 - weekday) for f in terms]


# Fixed values: (name, month, rule); a rule is a day, or (weekday Monday=0, nth; -1 = last).
US_HOLIDAYS = [
    ("new_year", 1, 1),
    ("martin_luther_king", 1, (0, 3)),
    ("washington", 2, (0, 3)),
    ("memorial", 5, (0, -1)),
    ("juneteenth", 6, 19),
    ("independence", 7, 4),
    ("labor", 9, (0, 1)),
    ("columbus", 10, (0, 2)),
    ("veterans", 11, 11),
    ("thanksgiving", 11, (3, 4)),
    ("christmas", 12, 25),
]


def us_holiday(ds: Column) -> dict[str, Column]:
    """One indicator per US holiday, by calendar rule; nothing to look up or join."""
    month, day, weekday = F.month(ds), F.day(ds), F.weekday(ds)
    out = {}
    for name, m, rule in US_HOLIDAYS:
        if isinstance(rule, int):
            hit = (month == m) & (day == rule)
            if name == "juneteenth":
                hit = hit & (F.year(ds) >= 2021)
        else:
            which, nth = rule
            if nth > 0:
                when = (day > 7 * (nth - 1)) & (day <= 7 * nth)
            else:
                when = day > F.day(F.last_day(ds)) - 7
            hit = (month == m) & (weekday == which) & when
        out[name] = F.when(hit, 1.0).otherwise(0.0)
    return out
