"""Scores and small arithmetic as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights, thresholds, the earth's radius.
WEIGHTS = {"name_score": 0.45, "age_score": 0.20, "gender_score": 0.20, "location_score": 0.15}
CONFIRMED, UNCONFIRMED = 0.78, 0.55
EARTH_KM = 6371


def half_up(x: Column, digits: int) -> Column:
    """floor(x * 10**digits + 0.5) / 10**digits on doubles."""
    k = float(10**digits)
    return F.floor(x.cast("double") * k + 0.5) / F.lit(k)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    rad = lambda x: x * (math.pi / 180)
    h = F.pow(F.sin(rad(lat2 - lat1) / 2), 2) + F.cos(rad(lat1)) * F.cos(rad(lat2)) * F.pow(F.sin(rad(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def age_score(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.when(d.isNull(), 0.5).when(d == 0, 1.0).when(d <= 2, 0.9).when(d <= 5, 0.7).when(d <= 10, 0.4).otherwise(0.0)


def gender_score(a: Column, b: Column) -> Column:
    known = lambda x: F.when(~F.upper(F.trim(x)).isin("", "NULL", "UNKNOWN"), F.upper(F.trim(x)))
    same = known(a) == known(b)
    return F.when(same.isNull(), 0.5).when(same, 1.0).otherwise(0.0)


def location_score(unit_a: Column, unit_b: Column, district_a: Column, district_b: Column, km: Column) -> Column:
    """The same unit, else the same district, else within 5 or 20 km (a null distance is far)."""
    filled = lambda x, y: (F.length(x) > 0) & (x == y)
    return F.when(filled(unit_a, unit_b), 1.0).when(filled(district_a, district_b), 0.6).when(km <= 5, 0.8).when(km <= 20, 0.4).otherwise(0.0)


def composite(scores: dict[str, Column]) -> Column:
    """Weighted sum of the four scores, each rounded before, rounded after."""
    total = None
    for name, w in WEIGHTS.items():
        part = scores[name] * w
        total = part if total is None else total + part
    return half_up(total, 2)


def gate(score: Column) -> Column:
    return F.when(F.isnan(score), "DISCARD").when(score >= CONFIRMED, "CONFIRMED").when(score >= UNCONFIRMED, "UNCONFIRMED").otherwise("DISCARD")


def risk_score(cases: Column, types: Column, recurring: Column, co_accused: Column | None = None) -> Column:
    """0 to 10: cases count most, then recurrence, variety and, where known, company."""
    raw = 2.5 * cases + F.when(recurring, 2.0).otherwise(0.0) + F.least(types, F.lit(3)) + (F.least(co_accused, F.lit(2)) if co_accused is not None else F.lit(0))
    return F.least(F.lit(10.0), half_up(raw, 1))


def severity(score: Column) -> Column:
    return F.when(score >= 7, "High").when(score >= 4, "Medium").otherwise("Low")


def crc_id(prefix: str, *parts: Column) -> Column:
    """An id from the CRC-32 of the parts, as eight hex digits."""
    return F.concat(F.lit(prefix), F.lpad(F.lower(F.hex(F.crc32(F.concat_ws("|", *parts).cast("binary")))), 8, "0"))


def weeks_between(a: Column, b: Column) -> Column:
    """Whole weeks from a date to another, rounded half up."""
    return F.floor(F.datediff(b, a) / 7 + 0.5).cast("int")


def finite(x: Column) -> Column:
    """Whether a number is there and finite."""
    return x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))


def monday(day: Column) -> Column:
    return F.date_trunc("week", day).cast("date")
