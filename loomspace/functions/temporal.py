"""Recency, periodic and sequence scores as column expressions. Ages are seconds before an explicit ``as_of``."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Horizons and half-lives by scale, in seconds.
HORIZON = {"micro": 300, "meso": 3600, "macro": 604800, "long": 2592000, "archival": 31536000}
HALF_LIFE = {"micro": 60, "meso": 1800, "macro": 43200, "long": 259200, "archival": 2592000}


def age(as_of: Column, ts: Column) -> Column:
    """Whole seconds from ts to as_of, at least 0."""
    return F.greatest(F.lit(0), F.unix_seconds(as_of) - F.unix_seconds(ts)).cast("double")


def linear(age_s: Column, horizon: float) -> Column:
    return 1 - F.least(age_s / F.lit(float(horizon)), F.lit(1.0))


def exponential(age_s: Column, half_life: float | Column) -> Column:
    half = half_life if isinstance(half_life, Column) else F.lit(float(half_life))
    return F.exp(-age_s * F.lit(math.log(2)) / half)


def stepped(age_s: Column) -> Column:
    """5 minutes 1, an hour .8, a day .5, a week .3, else .1."""
    return F.when(age_s < 300, 1.0).when(age_s < 3600, 0.8).when(age_s < 86400, 0.5).when(age_s < 604800, 0.3).otherwise(0.1)


def tool_recency(age_s: Column, horizon: float) -> Column:
    """The search tool's own decay: a quarter of the horizon as half-life and 0.693 for ln 2."""
    return F.exp(-age_s * 0.693 / F.lit(horizon / 4.0))


def adaptive_half_life(base: float, n: Column) -> Column:
    return F.lit(float(base)) * (1 + 0.1 * F.log10(n / 1000))


def day_of_week(ts: Column) -> Column:
    """Sunday is 0."""
    return F.dayofweek(ts) - 1


def day_name(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")


def cyclic(a: Column, b: Column, period: int) -> Column:
    d = F.abs(a - b)
    return F.least(d, period - d)


def periodic(ts: Column, hour: int | Column | None = None, weekday: int | Column | None = None) -> Column:
    """Mean of the hour's and the weekday's cyclic match; 0.5 if neither is asked for."""
    parts = []
    if hour is not None:
        parts.append(1 - cyclic(F.hour(ts), F.lit(hour) if isinstance(hour, int) else hour, 24) / 12)
    if weekday is not None:
        parts.append(1 - cyclic(day_of_week(ts), F.lit(weekday) if isinstance(weekday, int) else weekday, 7) / 3.5)
    return sum(parts[1:], parts[0]) / len(parts) if parts else F.lit(0.5)


def proximity_exp(distance: Column, most: float) -> Column:
    return F.exp(-3 * distance / F.lit(float(most)))


def proximity_linear(distance: Column, most: float) -> Column:
    return 1 - F.least(distance.cast("double"), F.lit(float(most))) / F.lit(float(most))


def boosted(similarity: Column, score: Column, weight: float) -> Column:
    """similarity * clamp(1 + weight * (score - 0.5), 0.8, 1.2)."""
    return similarity * F.greatest(F.lit(0.8), F.least(F.lit(1.2), 1 + F.lit(weight) * (score - 0.5)))


def blended(similarity: Column, weight: float, **scores: Column) -> Column:
    """similarity * (1 - weight) + weight * mean of active scores by .50 / .15 / .35."""
    # Shares of the temporal parts.
    share = {"recency": 0.50, "periodic": 0.15, "sequence": 0.35}
    whole = sum(share[k] for k in scores)
    mixed = sum((F.lit(share[k] / whole) * s for k, s in scores.items()), F.lit(0.0))
    return similarity * (1 - weight) + F.lit(weight) * mixed


def injection_factor(age_s: Column) -> Column:
    """Recency factor of context injection."""
    return F.when(age_s < 3600, 1.3).when(age_s < 86400, 1.2).when(age_s < 604800, 1.1).when(age_s < 2592000, 1.0).otherwise(0.8)


def spoken_age(age_s: Column) -> Column:
    """'2 hours ago'."""
    a = age_s.cast("long")
    parts = [(60, 1, "second"), (3600, 60, "minute"), (86400, 3600, "hour"), (604800, 86400, "day"), (1 << 62, 604800, "week")]
    out = None
    for limit, unit, word in parts:
        n = F.floor(a / unit)
        text = F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
        out = F.when(a < limit, text) if out is None else out.when(a < limit, text)
    return out


def badges(e2: Column, e3: Column, e4: Column) -> Column:
    """Temporal badges of a hit."""
    day = F.when(e3 > 0.7, "same day").when(e3 > 0.6, "same period")
    return F.array_compact(F.array(F.when(e2 > 0.8, "same session"), day, F.when(e4 > 0.6, "same sequence")))


def badge_bits(e2: np.ndarray, e3: np.ndarray, e4: np.ndarray) -> np.ndarray:
    """The badges of pairs as bits; similarities count to 12 places."""
    more = lambda x, limit: x > limit + 5e-13
    bits = ((e2, 0.8), (e3, 0.7), (e3, 0.6), (e4, 0.6))
    return sum((np.where(more(x, limit), np.int32(1 << k), np.int32(0)) for k, (x, limit) in enumerate(bits)), np.int32(0))


def badges_of(bits: Column) -> Column:
    """As ``badges``, of the bits."""
    has = lambda k: bits.bitwiseAND(F.lit(1 << k)) != 0
    return F.array_compact(F.array(F.when(has(0), "same session"), F.when(has(1), "same day").when(has(2), "same period"), F.when(has(3), "same sequence")))


def recency_encoding(ts: Column, dim: int = 512) -> Column:
    """Unit vector of sin / cos of ts / 86400^(2k / dim)."""
    t = F.unix_seconds(ts).cast("double")
    angles = F.transform(F.sequence(F.lit(0), F.lit(dim // 2 - 1)), lambda k: t / F.pow(F.lit(86400.0), 2 * k / F.lit(float(dim))))
    raw = F.flatten(F.transform(angles, lambda a: F.array(F.sin(a), F.cos(a))))
    return F.transform(raw, lambda x: x / F.lit(math.sqrt(dim / 2)))


def periodic_encoding(ts: Column, periods=(3600, 86400, 604800, 2592000, 31536000), harmonics: int = 51, dim: int = 512) -> Column:
    """Fourier features of the periods, harmonics 1..n, zero-padded to ``dim`` and of unit length."""
    t = F.unix_seconds(ts).cast("double")

    def waves(p: float) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(harmonics)), lambda h: F.array(F.sin(2 * math.pi * h * t / p), F.cos(2 * math.pi * h * t / p))))

    parts = [waves(float(p)) for p in periods]
    size = math.sqrt(len(periods) * harmonics)
    return F.concat(F.transform(F.concat(*parts), lambda x: x / F.lit(size)), F.array_repeat(F.lit(0.0), dim - 2 * harmonics * len(periods)))


def positional_encoding(session: Column, position: Column, dim: int = 512) -> Column:
    """Half a session's signature (hashed signs), half its sinusoidal position; each half has half the energy."""
    half = dim // 2
    sign = F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda k: F.when(F.pmod(F.xxhash64(session, k), F.lit(2)) == 0, 1.0).otherwise(-1.0) / math.sqrt(half))
    wave = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(half // 2 - 1)), lambda k: F.array(F.sin(position / F.pow(F.lit(10000.0), 2 * k / F.lit(float(half)))), F.cos(position / F.pow(F.lit(10000.0), 2 * k / F.lit(float(half)))))))
    wave = F.transform(wave, lambda x: x / math.sqrt(half / 2))
    return F.transform(F.concat(sign, wave), lambda x: x / math.sqrt(2))
