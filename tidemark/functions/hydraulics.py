"""Gate hydraulics and operator-facing labels as column expressions. A null or non-finite input gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: gravity in m/s2. From this blockage on the model does not hold.
GRAVITY, BEYOND = 9.81, 0.85


def finite(x: Column) -> Column:
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)


def blockage_factor(x: Column, scale: float = 1.0, bias: float = 0.0) -> Column:
    v = finite(x)
    return F.when(v.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), v * scale + bias)))


def afflux_ratio(bf: Column) -> Column:
    return F.when(bf < BEYOND, 1 / ((1 - bf) * (1 - bf)))


def discharge(bf: Column, area: float, head: Column, cd: float = 0.61) -> Column:
    return F.when((head > 0) & F.lit(area > 0), F.lit(cd) * area * (1 - bf) * F.sqrt(2 * GRAVITY * head))


def critical_bf(h0: Column, z: Column) -> Column:
    return F.when((h0 > 0) & (h0 < z), 1 - F.sqrt(h0 / z))


def head_m(bf: Column, clear_head: Column) -> Column:
    """Upstream level at a blockage."""
    return clear_head * afflux_ratio(bf)


def afflux_m(bf: Column, clear_head: Column) -> Column:
    """How much higher the water stands than at a clear gate."""
    return clear_head * (afflux_ratio(bf) - 1)


def margin_m(bf: Column, clear_head: Column, road: Column) -> Column:
    """What is left to the road; negative when it is under water."""
    return road - head_m(bf, clear_head)


def gate_summary(share: Column, clear_head: float, road: float, width: float, opening: float, scale: float = 1.0, bias: float = 0.0, cd: float = 0.61, calibrated: bool = False) -> Column:
    """What a gate does at a blocked share, as a struct of twelve fields. Discharge is that at the clear level, clear and blocked."""
    bf, h0, z = blockage_factor(share, scale, bias), F.lit(float(clear_head)), F.lit(float(road))
    area = width * opening
    known = F.when(bf.isNotNull(), discharge(bf, area, h0, cd))
    return F.struct(
        bf.alias("bf"), F.coalesce(bf >= BEYOND, F.lit(False)).alias("beyond_model"), afflux_ratio(bf).alias("afflux_ratio"), afflux_m(bf, h0).alias("afflux_m"),
        head_m(bf, h0).alias("head_m"), h0.alias("clear_head_m"), discharge(F.lit(0.0), area, h0, cd).alias("clear_discharge"), F.when(bf < 1, known).alias("blocked_discharge"),
        critical_bf(h0, z).alias("critical_bf"), margin_m(bf, h0, z).alias("margin_m"), z.alias("road_m"), F.lit(calibrated).alias("calibrated"),
    )


def echo_cm(micros: Column, speed_cm_us: float = 0.034) -> Column:
    """Distance of an echo that took ``micros`` there and back."""
    return micros * speed_cm_us / 2


def area_flux(coverage: Column, velocity: Column, width: Column, metric: Column) -> Column:
    """(flux, units): coverage times velocity times width to six places; without a velocity there is none."""
    flux = F.bround((coverage * velocity * width).cast("double"), 6)
    return F.struct(flux.alias("flux"), F.when(velocity.isNull(), "n/a").when(metric, "m2/s").otherwise("relative_index").alias("units"))


def relative_label(seconds: Column) -> Column:
    """Age in words, rounded down; the future and the last ten seconds are just now."""
    unit = lambda n, word: F.concat(F.floor(seconds / n).cast("string"), F.lit(" " + word))
    return F.when(seconds < 10, "baru saja").when(seconds < 60, unit(1, "detik lalu")).when(seconds < 3600, unit(60, "menit lalu")).when(seconds < 86400, unit(3600, "jam lalu")).otherwise(unit(86400, "hari lalu"))
