"""Lens arithmetic as columns, used inside bulk jobs over camera, subject and lens rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

_SENSORS = {k: (w, h, c) for k, w, h, c in K.SENSORS}


def sensor_value(sensor: Column, which: int) -> Column:
    """Width (0), height (1) or circle of confusion (2) of a sensor key; unknown keys give null."""
    out = F.lit(None).cast("double")
    for key, spec in _SENSORS.items():
        out = F.when(sensor == key, F.lit(spec[which])).otherwise(out)
    return out


def field_of_view(width_mm: Column, focal_mm: Column) -> Column:
    return F.when(focal_mm > 0, 2.0 * F.degrees(F.atan(width_mm / (2.0 * focal_mm))))


def framed(size_mm: Column, focal_mm: Column, distance_m: Column) -> Column:
    """World extent in metres that fills the sensor side ``size_mm`` at a distance."""
    return F.when((focal_mm > 0) & (distance_m > 0), distance_m * size_mm / focal_mm)


def distance_for(height_mm: Column, focal_mm: Column, framed_m: Column) -> Column:
    return F.when((focal_mm > 0) & (framed_m > 0), framed_m * focal_mm / height_mm)


def focal_for(height_mm: Column, distance_m: Column, framed_m: Column) -> Column:
    return F.when((distance_m > 0) & (framed_m > 0), height_mm * distance_m / framed_m)


def depth_of_field(focal: Column, aperture: Column, confusion: Column, distance_m: Column) -> dict[str, Column]:
    """Near and far sharp limits and the hyperfocal distance, metres; far is infinite past hyperfocal."""
    hyper = focal * focal / (aperture * confusion) + focal
    d = distance_m * 1000.0
    ok = (focal > 0) & (aperture > 0) & (distance_m > 0)
    near = d * (hyper - focal) / (hyper + d - 2.0 * focal)
    far = F.when(d >= hyper, F.lit(float("inf"))).otherwise(d * (hyper - focal) / F.nullif(hyper - d, F.lit(0.0)))
    return {
        "near_m": F.when(ok, near / 1000.0),
        "far_m": F.when(ok, far / 1000.0),
        "hyperfocal_m": F.when(ok, hyper / 1000.0),
    }


def _closest(value: Column, options: list[tuple[object, float]]) -> Column:
    """The option whose size is closest to ``value`` in ratio; the first one wins a tie."""
    v = F.greatest(value, F.lit(1e-6))
    ranked = F.array(*[
        F.struct(F.abs(F.ln(v / size)).alias("d"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, size) in enumerate(options)
    ])
    return F.when(value.isNotNull(), F.array_min(ranked)["name"])


def classify_framing(framed_m: Column) -> Column:
    return _closest(framed_m, [(name, h) for _, name, h in K.SHOTS])


def nearest_prime(focal_mm: Column) -> Column:
    return _closest(focal_mm, [(p, p) for p in K.PRIMES_MM])


def slug(text: Column) -> Column:
    """Lower-case, every run of other characters to one dash, no dash at the ends, never empty.

    Letters and digits of any script count, as a file name built this way must keep foreign titles readable.
    """
    dashed = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(dashed, "^-|-$", ""), F.lit("")), F.lit("twin"))
