"""Other scalar expressions: schedules, tolerances, parsers, JSON and state derivation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(c: Column, low: float, high: float) -> Column:
    """Held within bounds."""
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def coverage_step(c: Column) -> Column:
    """Coverage held to 24-96 and rounded to multiples of four, halves to even."""
    return F.bround(clip(c.cast("double"), 24.0, 96.0) / 4.0) * 4.0


def anneal(k: Column) -> Column:
    """Jitter that shrinks with the number of frames."""
    return F.greatest(F.lit(0.2), 1.0 - 0.4 * k / 50.0)


def widen(value: Column, lost: Column) -> Column:
    """A spread widened by the number of frames lost, four at most."""
    return value * (1.0 + 2.0 * F.least(lost, F.lit(4)))


def drift_tolerance(dt: Column) -> Column:
    """Metres that dead reckoning may be off after ``dt`` seconds."""
    return F.least(30.0 + dt + 0.05 * dt * dt, F.lit(120.0))


def streak_needed(jump: Column) -> Column:
    """Frames that must confirm a jump of so many metres."""
    return F.least(F.lit(20), 10 + F.ceil(jump / 50.0)).cast("int")


def estimate_variance(spread: Column, n: float, neff: Column, age: Column) -> Column:
    """Variance to report with a position."""
    return F.greatest(F.lit(4.0), 0.5 * spread * spread * F.greatest(F.lit(1.0), F.lit(n) / neff)) + age * age


def rescan_radius(gap: Column, fails: Column) -> Column:
    """Radius of the next local search."""
    return F.least(F.lit(2000.0), F.greatest(F.lit(40.0), 15.0 * gap) * F.pow(F.lit(1.5), fails))


def parse_pair(s: Column, a: float, b: float) -> tuple[Column, Column]:
    """Two numbers separated by a comma; the defaults for anything else."""
    parts = F.split(s, ",")
    x, y = F.trim(F.try_element_at(parts, F.lit(1))).try_cast("double"), F.trim(F.try_element_at(parts, F.lit(2))).try_cast("double")
    ok = F.coalesce((F.size(parts) == 2) & x.isNotNull() & y.isNotNull(), F.lit(False))
    return F.when(ok, x).otherwise(a), F.when(ok, y).otherwise(b)


def file_month(name: Column) -> Column:
    """Months since year zero of the date in a file name: leading yyyymm or _yyyymmdd before the suffix, else 0."""
    y, m = F.substring(name, 1, 4).try_cast("int"), F.substring(name, 6, 2).try_cast("int")
    date = F.regexp_extract(name, r"_(\d{4})(\d{2})\d{2}\.", 0)
    later = F.regexp_extract(name, r"_(\d{4})(\d{2})\d{2}\.", 1).try_cast("int") * 12 + F.regexp_extract(name, r"_(\d{4})(\d{2})\d{2}\.", 2).try_cast("int")
    return F.coalesce(y * 12 + m, F.when(date != "", later), F.lit(0))


def health_state(k: Column, ready: Column, gated: Column, recovering: Column, lost: Column) -> Column:
    """A tracker's state by priority: no frame yet, not initialised, motion only, recovering, lost frames, else tracking."""
    return (
        F.when(F.coalesce(k, F.lit(-1)) < 0, "no_frames").when(~F.coalesce(ready, F.lit(False)), "init_wait").when(gated, "motion_only").when(recovering, "recovering").when(lost > 0, "lost").otherwise("tracking")
    )


def source_pixels(coverage: Column, gsd: float) -> Column:
    """Map pixels that a patch of so many metres takes."""
    return coverage / gsd


def homeward(x: Column, y: Column, speed: float) -> tuple[Column, Column, Column]:
    """(north, east, heading) of a velocity towards the map's centre; null without a position."""
    d = F.greatest(F.hypot(x, y), F.lit(1e-3))
    north, east = -speed * y / d, -speed * x / d
    return north, east, F.atan2(east, north)


def planned_speed(distance: Column, cap: float, gain: float = 0.7) -> Column:
    """Speed of a proportional controller."""
    return F.least(F.lit(cap), gain * distance)


def odometry_sane(alt: Column, roll_deg: Column, pitch_deg: Column) -> Column:
    """Whether height and tilt are those of a flying vehicle; unknown ones aren't."""
    return F.coalesce(alt.between(3.0, 400.0) & ~F.isnan(alt) & (F.abs(roll_deg) < 55) & (F.abs(pitch_deg) < 55), F.lit(False))


def odometry_class(sane: Column, dx: Column, dy: Column, turn_deg: Column, dt: Column) -> Column:
    """``bad``: not to be believed; ``resume``: believed, but moved or turned further since the last one believed than the
    time allows, so only an anchor; ``ok``: to be used, as is a first one (``dt`` null). Limits grow with the gap."""
    gap = F.greatest(F.lit(0.0), dt - 0.5)
    inside = (F.abs(dx) < 15.0 + 15.0 * gap) & (F.abs(dy) < 15.0 + 15.0 * gap) & (F.abs(turn_deg) < 45.0 + 90.0 * gap)
    return F.when(~sane, "bad").when(dt.isNull() | inside, "ok").otherwise("resume")
